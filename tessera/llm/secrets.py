"""Secret scans: candidates by patterns, false positives removed by a random forest; DataFrame functions only.

A candidate's length, character transitions, dictionary coverage, path context and neighbouring words feed a random
forest trained on labelled findings. The fitted trees are turned into one column expression, so whole texts are
scanned, judged and redacted row by row inside the scan: nothing is shuffled and no finding leaves its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import free_name

#: Fixed patterns of candidates: whole private keys, named forms, values assigned to a telling name (of any characters, six
#: or more), and mixed strings of 16 characters or more. Nothing else can be found; the forest only rejects.
PATTERNS = [
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,.\s-]{0,16384}?-----END [A-Z ]{0,24}PRIVATE KEY-----|(?:\s{1,4}[A-Za-z0-9+/]{40,128}+={0,2})*+(?:\s{1,4}[A-Za-z0-9+/]{1,64}+={1,2})?)",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])gh[pousr]_[0-9A-Za-z]{36,}",
    r"(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{10,}",
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?<=[=:\"'\s])(?<=(?i:password|passwort|passwd|pwd|passphrase|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"'<>,;(){}\[\]]{6,256}",
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}",
]
PATTERN = "|".join(PATTERNS)
#: Fixed words: parts of identifiers that speak against a random string, and neighbours that speak for or against a secret.
DICTIONARY = "access account action address admin agent alpha amount animal answer array article async author avatar backup banner basic batch beta block board body border bottom box branch bucket build button cache camera card category center change channel chapter chart chat check city class clean click client close cloud code color column comment commit common company compile config connect container content control copy count country create credential current custom data date debug default delete demo design detail device dialog digest disable display document domain download driver dummy edit editor element email enable engine entry error event example export feature field file filter first folder footer form frame free from function gallery gateway get global group guide handler head header height hello help here history home host icon image import index info inline input insert install instance integer internal item job key label language large last layout left length level library light limit line link list load local location login logo main manager map mark master max media menu message method middle migration mobile model module month name native navigation network new next node not null number object offset open option order output package page panel parent password path payment phone photo picture place placeholder player point popup port position post prefix preview price primary private process product profile project property public query queue random range rate reader record red release remote remove render replace report request reset resource response result return right role root route row rule sample schema screen script scroll search second secret section select send server service session set setting share short show side sidebar simple single site size slide small social sort source stack standard start state static status step store string style submit support switch system table tag target task template test text theme thumb time title toggle token tool top total track transaction tree type update upload user util value version video view web week width window word work world wrapper year your zip".split()
FOR = "token|secret|password|passwd|pwd|credential|bearer|authorization|api|apikey|access|auth|private|key"
AGAINST = "commit|sha|sha1|sha256|sha512|hash|checksum|digest|md5|integrity|revision|uuid|guid|etag|example|sample|dummy|test|placeholder|fixture|blob|tree|parent|index|build|version"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
FEATURES = ["length", "digits", "uppers", "vowels", "changes", "pairs", "distinct", "is_hex", "coverage", "in_path", "slashes", "assigned", "quoted", "words_for", "words_against"]
LEFT, RIGHT = 48, 24  # characters of context on either side


def features(value: Column, left: Column, right: Column) -> list[Column]:
    """The forest's inputs, in the order of FEATURES, all doubles."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low, near = F.lower(value), F.lower(left)
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    known = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    changes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    words = lambda w: F.regexp_count(near, F.lit(rf"(?<![a-z0-9])(?:{w})(?![a-z0-9])")).cast("double")
    return [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        F.regexp_count(low, F.lit("[aeiou]")) / n,
        share(changes),
        F.regexp_count(low, F.lit(rf"(?={PAIRS.replace('|', '|(?=').replace('|(?=', ')|(?=')})")) / n,
        F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
        flag(low.rlike("^[0-9a-f-]+$")),
        1 - F.length(F.regexp_replace(low, known, "")) / n,
        flag(left.rlike(r"(?:[/\\.]|://\S*)$") | right.rlike(r"^(?:[/\\]|\.[a-z]{2,4}\b)")),
        share("/"),
        flag(left.rlike(r"[=:]\s*[\"']?$")),
        flag(left.rlike("[\"']$") & right.rlike("^[\"']")),
        words(FOR),
        words(AGAINST),
    ]


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Findings with labels (left, value, right, label): context templates around digests of a counter.

    n is the documented bound of the training sample.
    """
    i = F.col("id")
    hexes = F.sha2(F.concat(F.lit("a"), i), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i), 512))), r"\s", "")
    alnum = F.regexp_replace(b64, "[+/=]", "")
    upper = F.upper(F.substring(alnum, 1, 16))
    word = lambda seed: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(len(DICTIONARY))) + 1).cast("int"))
    number = F.pmod(F.xxhash64(F.lit(9), i), F.lit(10_000)).cast("string")
    prose = F.concat(word(1), F.lit(" "), word(2), F.lit(" the "))
    uuid = F.concat_ws("-", *[F.substring(hexes, *p) for p in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    lit = F.lit
    kinds = [
        ("token = \"", F.substring(hexes, 1, 40), "\"", 1),
        ("password=", F.substring(hexes, 1, 18), " ", 1),
        ("api_key: ", F.substring(alnum, 1, 32), "\n", 1),
        ("", F.concat(lit("AKIA"), upper), " ", 1),
        ("Authorization: Bearer ", F.substring(alnum, 1, 48), "\n", 1),
        ("", F.concat(lit("ghp_"), F.substring(alnum, 1, 36)), " ", 1),
        ("secret = '", b64, "'", 1),
        ("", F.concat(lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.substring(F.repeat(b64, 8), 1, 600), lit("\n-----END RSA PRIVATE KEY-----")), "\n", 1),
        ("DB_PASSWORD=", F.concat(F.initcap(word(3)), number, lit("!"), F.substring(alnum, 1, 3)), "\n", 1),
        ("password = \"", F.concat(F.substring(alnum, 1, 4), lit("&"), F.substring(alnum, 5, 5)), "\"", 1),
        ("passwd: ", F.concat(F.substring(alnum, 1, 2), word(4), lit("#"), F.substring(number, 1, 2)), "\n", 1),
        ("secret=", F.lower(F.regexp_replace(alnum, "[0-9]", "")), " ", 1),
        ("password=", F.concat(word(4), F.substring(number, 1, 2), lit("!")), " ", 1),
        ("Authorization: Bearer ", F.substring(hexes, 1, 64), "\n", 1),
        ("token: ", word(3), " ", 0),
        ("password: ", F.translate(F.substring(hexes, 1, 8), "0123456789abcdef", "aeioulnrstaeidom"), " ", 0),
        ("", F.concat(F.upper(word(4)), lit("_"), F.translate(F.substring(hexes, 1, 8), "abcdef", "012345"), lit("_"), word(5)), " ", 0),
        ("", F.concat(lit("/"), word(4), lit("/"), word(5), lit("/"), word(6), number), "/", 0),
        ("the secret: ", F.concat(word(4), lit(".")), " ", 0),
        ("password: ", F.concat_ws("-", lit("your"), word(3)), "\n", 0),
        ("api_key = \"", F.concat_ws("_", lit("insert"), word(5), lit("here")), "\"", 0),
        ("password=", F.concat(lit("os.environ."), word(6)), "\n", 0),
        ("token = ", F.concat(word(4), lit("."), word(5), F.initcap(word(6))), "\n", 0),
        ("secret: $", F.concat(F.upper(word(4)), lit("_"), F.upper(word(5))), "\n", 0),
        ("commit ", F.substring(hexes, 1, 40), "\n", 0),
        ("sha256:", F.substring(hexes, 1, 64), " ", 0),
        ("/static/js/", F.substring(hexes, 1, 20), ".js", 0),
        ("id: ", uuid, ",", 0),
        ("integrity=\"", F.concat(lit("sha512-"), b64), "\"", 0),
        ("token = \"", F.concat_ws("_", lit("your"), word(3), lit("example"), number), "\"", 0),
        ("", F.concat(word(4), F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(7)), number), "(", 0),
        ("https://example.com/", F.concat_ws("-", word(4), word(5), word(6), number, word(7)), "/", 0),
    ]
    pick = F.pmod(i, F.lit(len(kinds)))
    choose = lambda at: reduce(lambda c, k: c.when(pick == k[0], k[1][at] if isinstance(k[1][at], Column) else F.lit(k[1][at])), list(enumerate(kinds))[1:], F.when(pick == 0, kinds[0][at] if isinstance(kinds[0][at], Column) else F.lit(kinds[0][at])))
    return spark.range(0, n, 1, 1).select(F.concat(prose, choose(0)).alias("left"), choose(1).alias("value"), choose(2).alias("right"), choose(3).alias("label"))


def train(labelled: DataFrame, trees: int = 24, depth: int = 6, seed: int = 7):
    """A function from FEATURES columns to the probability that a finding is a secret.

    labelled: left, value, right, label; it should be a bounded table, as it is read by one task so that the same rows
    give the same trees on any cluster. With one class only, every finding gets that class.
    """
    named = [c.alias(n) for n, c in zip(FEATURES, features(F.col("value"), F.col("left"), F.col("right")), strict=True)]
    rows = labelled.filter(F.col("value").isNotNull() & F.col("label").isNotNull()).withColumns({c: F.coalesce(c, F.lit("")) for c in ("left", "right")})
    rows = rows.select(*named, F.col("label").cast("double").alias("label")).coalesce(1).sortWithinPartitions(*FEATURES, "label")
    # A bounded table of short rows, held for the forest's passes.
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label").cache()
    classes = [r[0] for r in rows.select("label").distinct().collect()]
    if len(classes) < 2:
        rows.unpersist()
        return lambda columns: F.lit(classes[0] if classes else 1.0)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    rows.unpersist()
    roots = [t._call_java("rootNode") for t in model.trees]

    def expression(node, columns: list[Column]) -> Column:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / sum(stats)))
        split = node.split()
        return F.when(columns[split.featureIndex()] <= float(split.threshold()), expression(node.leftChild(), columns)).otherwise(expression(node.rightChild(), columns))

    return lambda columns: reduce(lambda a, b: a + b, (expression(r, columns) for r in roots)) / F.lit(float(len(roots)))


def scan(df: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """df with _findings, an array of (start, length, value, score, secret) per row, and _clean, the text redacted.

    start counts characters from 0. A null text has no findings and stays null. labelled defaults to
    labelled_findings(). Columns of df named _findings or _clean are replaced.
    """
    score = train(labelled if labelled is not None else labelled_findings(df.sparkSession))
    text = F.col(text_col)
    found = _bind(F.regexp_extract_all(text, F.lit(PATTERN), 0), lambda values: _bind(F.split(text, PATTERN, -1), lambda gaps: _judged(values, gaps, score, threshold)))
    own = free_name(df, "_scan")
    rows = df.drop("_findings", "_clean").withColumn(own, F.when(text.rlike(PATTERN), found))
    return rows.withColumns({"_findings": F.col(f"{own}.findings"), "_clean": F.coalesce(F.col(f"{own}.clean"), text)}).drop(own)


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once a row: a lambda's argument is never inlined where it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _judged(values: Column, gaps: Column, score, threshold: float) -> Column:
    """findings and clean (null if there is no secret) of one text, from its candidates and the stretches between."""
    block, zero = 256, F.lit(0).cast("long")
    add = lambda a, x: a + x
    sums = lambda steps: F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(steps, b * block + 1, F.lit(block)), zero, add))

    def with_starts(steps: Column) -> Column:
        # Starts are prefix sums, by blocks so that texts with very many candidates stay cheap.
        before = lambda each: F.transform(each, lambda _, b: F.aggregate(F.slice(each, F.lit(1), b), zero, add))
        return _bind(sums(steps), lambda each: _bind(before(each), lambda blocks: F.transform(values, lambda v, i: finding(v, i, steps, blocks))))

    def finding(v: Column, i: Column, steps: Column, blocks: Column) -> Column:
        b = F.floor(i / block).cast("int")
        start = F.get(blocks, b) + F.aggregate(F.slice(steps, b * block + 1, i % block), zero, add) + F.length(F.get(gaps, i))
        context = F.struct(F.right(F.get(gaps, i), F.lit(LEFT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("right"))
        p = lambda f: score([F.get(f, k) for k in range(len(FEATURES))])
        scored = _bind(context, lambda c: _bind(F.array(*features(v, c["left"], c["right"])), p))
        return F.struct(start.alias("start"), F.length(v).cast("long").alias("length"), v.alias("value"), scored.alias("score"))

    def verdicts(found: Column) -> Column:
        judged = F.transform(found, lambda x: F.struct(*[x[k].alias(k) for k in ("start", "length", "value", "score")], (x["score"] >= threshold).alias("secret")))
        shown = lambda i: F.when(F.get(found, i)["score"] >= threshold, "[SECRET]").otherwise(F.coalesce(F.get(values, i), F.lit("")))
        clean = F.when(F.exists(found, lambda x: x["score"] >= threshold), F.array_join(F.transform(gaps, lambda g, i: F.concat(g, shown(i))), ""))
        return F.struct(judged.alias("findings"), clean.alias("clean"))

    steps = F.transform(values, lambda v, i: (F.length(F.get(gaps, i)) + F.length(v)).cast("long"))
    return _bind(steps, lambda st: _bind(with_starts(st), verdicts))


def findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per candidate: doc_id, finding (from 0 within its row), start, length, value, score, secret.

    Every row is scanned for itself: repeated rows and rows that share an id give their findings each, a null id stays null.
    Null, empty and clean texts have no rows, nor have empty tables. Other columns are ignored.
    """
    rows = scan(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", **options)
    return rows.select("doc_id", F.posexplode("_findings").alias("finding", "x")).select("doc_id", "finding", "x.*")


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """df with the secrets in its texts replaced by [SECRET]; chars_col, if given, is recounted where a text changed.

    All rows and columns stay, in any number of repeats; ids are not looked at. Null texts stay null. An empty table stays
    empty. Of a private key the whole block goes, from its BEGIN to its END; without an END, its header and what
    follows it in lines of base64.
    """
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"), F.col(text_col).alias("_text"))
    rows = scan(held, "_text", **options)
    hit = F.exists("_findings", lambda x: x["secret"])
    own = lambda c: F.col("_doc").getField(c)
    changed = {text_col: F.col("_clean")}
    if chars_col:
        changed[chars_col] = F.when(hit, F.length("_clean").cast("long")).otherwise(own(chars_col))
    return rows.select(*[changed.get(c, own(c)).alias(c) for c in df.columns])
