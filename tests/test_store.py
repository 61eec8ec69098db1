import pytest

from tessera.errors import Conflict, ConstraintViolation, EngineError, UnknownName
from tessera.store.database import Database


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def kv(db, spark):
    db.create_table("kv", {"k": "int", "v": "string", "n": "int"}, ["k"], not_null=["n"], defaults={"n": "7"}, unique={"kv_v": ["v"]})
    return db.insert("kv", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))


def test_insert_defaults_returning_and_duplicates(db, spark):
    done = kv(db, spark)
    assert rows(done.returning("k", "n + 1 AS m")) == [(1, 8), (2, 8)]
    with pytest.raises(Conflict):
        db.insert("kv", spark.createDataFrame([(3, "c"), (1, "x")], "k int, v string"))
    with pytest.raises(Conflict):
        db.insert("kv", spark.createDataFrame([(3, "a")], "k int, v string"))
    with pytest.raises(ConstraintViolation):
        db.insert("kv", spark.createDataFrame([(3, "c", None)], "k int, v string, n int"))
    with pytest.raises(UnknownName):
        db.insert("kv", spark.createDataFrame([(3, 4)], "k int, w int"))
    assert rows(db.table("kv")) == [(1, "a", 7), (2, "b", 7)]


def test_upserts(db, spark):
    kv(db, spark)
    source = spark.createDataFrame([(2, "z", 1), (3, "c", 2), (3, "d", 3), (4, None, 4)], "k int, v string, n int").coalesce(1)
    done = db.insert("kv", source, on_conflict="nothing", target=["k"])
    assert rows(done.rows) == [(3, "c", 2), (4, None, 4)]
    done = db.insert("kv", spark.createDataFrame([(1, "a", 5), (9, "q", 9)], "k int, v string, n int"), on_conflict="update", set={"n": "kv.n + excluded.n"}, where="excluded.n > 1")
    assert rows(done.rows) == [(1, "a", 12), (9, "q", 9)]
    with pytest.raises(Conflict):
        db.insert("kv", spark.createDataFrame([(1, "m", 5), (1, "o", 9)], "k int, v string, n int"), on_conflict="update", set={"n": "excluded.n"})


def test_update_and_delete_with_subqueries(db, spark):
    kv(db, spark)
    done = db.update("kv", {"k": "k + 10", "n": "(SELECT MAX(k) FROM {kv})"}, "k IN (SELECT MIN(k) FROM {kv})")
    assert rows(done.rows) == [(11, "a", 2)]
    assert rows(db.delete("kv", "v = 'b'").returning("k")) == [(2,)]
    assert rows(db.table("kv")) == [(11, "a", 2)]
    assert rows(db.table("kv", version=2)) == [(1, "a", 7), (2, "b", 7)]


def family(db, spark, on_delete="cascade", on_update="cascade"):
    db.create_table("parent", {"id": "int", "name": "string"}, ["id"])
    db.create_table("child", {"id": "int", "pid": "int"}, ["id"], defaults={"pid": "1"}, foreign_keys=[{"columns": ["pid"], "parent": "parent", "on_delete": on_delete, "on_update": on_update}])
    db.create_table("grandchild", {"id": "int", "cid": "int"}, ["id"], foreign_keys=[{"columns": ["cid"], "parent": "child", "on_delete": "cascade"}])
    db.insert("parent", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))
    db.insert("child", spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id int, pid int"))
    db.insert("grandchild", spark.createDataFrame([(100, 10), (200, 20)], "id int, cid int"))


def test_foreign_keys(db, spark):
    family(db, spark)
    with pytest.raises(ConstraintViolation):
        db.insert("child", spark.createDataFrame([(40, 9)], "id int, pid int"))
    db.update("parent", {"id": "5"}, "id = 2")
    assert rows(db.table("child")) == [(10, 1), (20, 5), (30, None)]
    db.delete("parent", "id = 5")
    assert rows(db.table("child")) == [(10, 1), (30, None)] and rows(db.table("grandchild")) == [(100, 10)]


@pytest.mark.parametrize(("action", "want"), [("set null", (20, None)), ("set default", (20, 1)), ("no action", None)])
def test_foreign_key_actions(db, spark, action, want):
    family(db, spark, action)
    if want is None:
        with pytest.raises(ConstraintViolation):
            db.delete("parent", "id = 2")
    else:
        db.delete("parent", "id = 2")
        assert want in rows(db.table("child"))


def test_transactions(db, spark):
    kv(db, spark)
    one, two, three = db.begin(), db.begin(), db.begin()
    one.update("kv", {"n": "1"}, "k = 1")
    assert rows(one.table("kv")) == [(1, "a", 1), (2, "b", 7)] and rows(two.table("kv"))[0] == (1, "a", 7)
    with pytest.raises(Conflict):
        one.insert("kv", spark.createDataFrame([(2, "x")], "k int, v string"))
    one.commit()
    two.update("kv", {"n": "2"}, "k = 1")
    three.update("kv", {"n": "3"}, "k = 2")
    with pytest.raises(Conflict):
        two.commit()
    three.commit()
    assert rows(db.table("kv")) == [(1, "a", 1), (2, "b", 3)]
    gone = db.begin()
    gone.delete("kv")
    gone.rollback()
    with pytest.raises(EngineError):
        gone.commit()
    assert db.table("kv").count() == 2


def test_alter_and_checks(db, spark):
    kv(db, spark)
    db.alter("kv", "add column", column="age", type="int", default="30")
    assert rows(db.table("kv")) == [(1, "a", 7, 30), (2, "b", 7, 30)]
    db.alter("kv", "add check", name="adult", expression="age >= 18")
    with pytest.raises(ConstraintViolation):
        db.update("kv", {"age": "3"}, "k = 1")
    db.update("kv", {"age": "NULL"}, "k = 1")
    db.alter("kv", "drop constraint", name="adult")
    db.alter("kv", "rename column", column="age", to="years")
    db.alter("kv", "set default", column="years", default="40")
    db.insert("kv", spark.createDataFrame([(3, "c")], "k int, v string"))
    assert rows(db.table("kv")) == [(1, "a", 7, None), (2, "b", 7, 30), (3, "c", 7, 40)]
    with pytest.raises(ConstraintViolation):
        db.alter("kv", "set not null", column="years")
    with pytest.raises(Conflict):
        db.create_index("u", "kv", ["n"], unique=True)
    db.create_schema("other")
    db.create_table("other.t", {"a": "int", "b": "int"}, ["a", "b"])
    assert db.table("other.t").count() == 0
    db.drop_table("other.t")
    with pytest.raises(UnknownName):
        db.table("other.t")
