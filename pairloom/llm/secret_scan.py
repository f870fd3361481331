"""Secret scan: candidates judged by a random forest, on DataFrame and SQL functions only.

A candidate is a run of 16 or more of ``A-Z a-z 0-9 + / _ -`` inside a word of a text (words end at ASCII white space) that holds a
digit, an issuer's prefix, or a capital behind a small letter, or that an assignment stands right before. The forest sees its length, shares of character kinds, how often the kind changes from one character to the next, how much of
it dictionary words cover, signs of a path, address or identifier, quotes and assignment before it, and what the neighbouring words
say. It is trained from labelled findings, a table with ``text`` (holding one candidate) and ``secret`` (0 or 1); without one,
``labelled_findings`` generates such a table from templates of credentials and of look-alikes (digests of files and commits, UUIDs,
paths, addresses, identifiers, numbers, placeholders). Null labels are not used, and labels of one kind alone are refused. Candidates that the forest holds
for harmless are reported with ``secret`` false: they are false positives of the pattern.

Null and empty texts have no findings; a score equal to the threshold counts as secret; the result has the id and the findings only,
whatever the names of other columns; each row is scanned by itself, so repeated rows repeat their findings and hot groups do not
matter; very long words hold as many candidates as they have, each judged once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import SPACE, column, table

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: A candidate holds a digit or a capital behind a small letter, or begins as issued keys do.
WANTED = r"[0-9]|[a-z][A-Z]|AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk[_-]|pk_live|xox[abprs]-|hf_|npm_|SG\.|eyJ"
#: A word whose candidates all count, as something is assigned in it, and the end of a word that assigns to the next one.
ASSIGNS, ASSIGNED = r"[=:][\"'`]?[A-Za-z0-9+/_\-]{16}", r"[=:][\"'`]?$"
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|private|credential|auth|bearer|signature)"
#: Beginnings that issuers give their keys.
ISSUED = r"^(AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk[_-](live|test|proj)|sk-|pk_live|xox[abprs]-|hf_|npm_|SG\.|eyJ)"
HARMLESS_WORDS = r"(?i)(commit|sha1|sha256|md5|checksum|digest|uuid|guid|version|revision|example|placeholder|dummy|order|invoice|phone|card|isbn|file|path)"
#: A fixed list of words that make identifiers, paths and placeholders.
DICTIONARY = (
    "access account action address admin agent alpha application archive array assets author backup balance batch binary block board body buffer build button cache "
    "callback campaign cancel channel check class client cloud cluster code column command comment common component config connect console content context control "
    "count create customer data database default delete delta deploy design detail device directory display document domain download driver dummy dynamic edit element "
    "email engine entry error event example export factory feature fetch field file filter final find folder format frame from function gateway global graph group handle "
    "handler header height home html http image import index info init input insert instance integration internal invoice item java json kernel label language layer layout "
    "length level library limit line link list load local location lock login main manager market master memory merge message method metric mobile model module monitor name "
    "network node null number object online option order output package page panel parent parser party path payload payment phone pixel place plugin point policy port post "
    "prefix price print process product profile project property protocol provider public query queue random range read record region register release remote report request "
    "reset resource response result return review root route scale schema scope script search section select send sequence server service session setting shared simple single "
    "sink size snapshot socket sort source space spark stage start state static status storage store stream string style submit summary support switch sync system table target "
    "task template test text theme thread time timer title token track transfer type union unit update upload user util value vector version video view widget width window work write your"
).split()
FEATURES = ["issued", "size", "digits", "upper", "lower", "marks", "changes", "runs", "covered", "hex", "uuid", "path", "address", "assigned", "quoted", "secret_near", "harmless_near", "different"]
TREES, DEPTH, SEED = 20, 6, 7


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, one row for each candidate: struct ``__f`` of word_index, nth, value, glued (before it in its word), after, before (two words), behind (one word)."""
    w = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda x: x != "")
    words = df.select(*(F.col(c) for c in df.columns if c != text), F.explode(F.array(w)).alias("__w"))
    assigned = lambda x, i: x.rlike(ASSIGNS) | F.coalesce(F.get("__w", i - 1).rlike(ASSIGNED), F.lit(False))
    found = F.filter(
        F.transform("__w", lambda x, i: F.when((F.length(x) >= 16) & x.rlike(CANDIDATE) & (x.rlike(WANTED) | assigned(x, i)), F.struct(i.alias("i"), x.alias("word"), F.concat_ws(" ", F.get("__w", i - 2), F.get("__w", i - 1)).alias("before"), F.coalesce(F.get("__w", i + 1), F.lit("")).alias("behind")))),
        lambda x: x.isNotNull(),
    )
    keep = [c for c in df.columns if c != text]
    hits = words.select(*keep, F.explode(found).alias("__h"))
    each = hits.select(*keep, "__h", F.posexplode(F.regexp_extract_all(F.col("__h.word"), F.lit(CANDIDATE), F.lit(0))).alias("__n", "__v"))
    first = F.instr(F.col("__h.word"), F.col("__v"))
    given = F.concat_ws(" ", F.col("__h.before"), F.substring(F.col("__h.word"), F.lit(1), first - 1))
    each = each.filter(F.col("__v").rlike(WANTED) | given.rlike(ASSIGNED))
    return each.select(
        *keep,
        F.struct(
            F.col("__h.i").cast("long").alias("word_index"),
            F.col("__n").cast("int").alias("nth"),
            F.regexp_replace("__v", "^[/_-]+|=+$", "").alias("value"),
            F.concat(F.substring(F.col("__h.word"), F.lit(1), first - 1), F.regexp_extract("__v", "^[/_-]*", 0)).alias("glued"),
            F.substring(F.col("__h.word"), first + F.length("__v"), F.lit(2**30)).alias("after"),
            F.col("__h.before").alias("before"),
            F.col("__h.behind").alias("behind"),
        ).alias("__f"),
    )


def features(f: str = "__f") -> list[Column]:
    v, before, glued = F.col(f"{f}.value"), F.col(f"{f}.before"), F.col(f"{f}.glued")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[a-z]", "1"), "[A-Z]", "2"), "[^012]", "3")
    share = lambda p: F.regexp_count(v, F.lit(p)) / n
    near = F.concat_ws(" ", before, glued)
    yes = lambda c: c.cast("double")
    known = F.regexp_replace(F.lower(v), "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w))), "")
    around = F.concat(glued, F.col(f"{f}.after"))
    named = dict(
        issued=yes(v.rlike(ISSUED)),
        size=F.least(n, F.lit(200.0)), digits=share("[0-9]"), upper=share("[A-Z]"), lower=share("[a-z]"), marks=share(r"[+/=_\-]"),
        changes=F.regexp_count(kinds, F.lit("(?<=0)[^0]|(?<=1)[^1]|(?<=2)[^2]|(?<=3)[^3]")) / n,
        runs=F.regexp_count(v, F.lit(r"(.)\1\1")) / n, covered=1 - F.length(known) / n,
        hex=yes(v.rlike("^[0-9a-fA-F]+$")), uuid=yes(v.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        path=yes(v.contains("/") | around.rlike(r"[/\\]|\.[a-z]{2,4}$")), address=yes(around.rlike(r"(?i)https?:|www\.|@")),
        assigned=yes(F.concat_ws(" ", before, glued).rlike(r"[=:]\s*[\"'`]?$")), quoted=yes(glued.rlike(r"[\"'`]$")),
        secret_near=yes(near.rlike(SECRET_WORDS)), harmless_near=yes(F.concat_ws(" ", near, F.col(f"{f}.behind")).rlike(HARMLESS_WORDS)),
        different=F.size(F.array_distinct(F.split(v, ""))) / n,
    )
    return [named[k].alias(k) for k in FEATURES]


def labelled_findings(spark: SparkSession, n: int = 4000, first: int = 0) -> DataFrame:
    """``n`` generated findings (text, secret) from the even row number ``first`` on: templates over its digests, half credentials, half look-alikes."""
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512)
    b64 = F.translate(F.base64(F.unhex(h)), "+=\n\r", "AB")
    pick = lambda salt, *xs: F.get(F.array(*(F.lit(x) for x in xs)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))).cast("int"))
    size = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    part = lambda col, start, k: F.substring(col, F.lit(start), k if isinstance(k, Column) else F.lit(k))
    name = pick(1, "token", "api_key", "apiKey", "secret", "password", "AUTH_TOKEN", "access-key", "client_secret", "bearer", "private_key")
    sign, quote = pick(2, " = ", "=", ": ", " := ", " "), pick(3, '"', "'", "")
    lead, tail = pick(4, "", "export ", "the value of ", "set ", "and with "), pick(5, "", " here", " then it ends", ";", ",")
    value = F.when(F.pmod("id", F.lit(8)) < 3, part(h, 1, size(6, 16, 64))).when(F.pmod("id", F.lit(8)) < 6, part(b64, 1, size(7, 20, 60))).otherwise(F.concat(pick(8, "sk_live_", "ghp_", "AIza", "xoxb-", "glpat-", "hf_"), part(F.translate(b64, "/", "C"), 9, size(9, 20, 40))))
    issued = F.when(F.pmod("id", F.lit(2)) == 0, F.concat(F.lit("AKIA"), part(F.translate(F.upper(b64), "/01", "C23"), 9, 16))).otherwise(F.concat(pick(33, "sk_live_", "ghp_", "AIza", "xoxb-", "glpat-"), part(F.translate(b64, "/", "C"), 9, size(9, 20, 40))))
    bad = F.when(F.pmod(F.xxhash64("id", F.lit(34)), F.lit(4)) == 0, F.concat(pick(35, "", "the of ", "and with "), quote, issued, quote, tail)).otherwise(F.concat(lead, name, sign, quote, value, quote, tail))
    word = lambda salt: pick(salt, *DICTIONARY)
    # some credentials have no digit: random letters, or words in a row behind an assignment
    letters = F.concat(lead, name, pick(2, " = ", "=", ": ", " := "), quote, part(F.translate(b64, "0123456789/", "ghijkmnpqrs"), 3, size(40, 16, 40)), quote, tail)
    phrase = F.concat(lead, name, pick(2, " = ", "=", ": ", " := "), quote, word(41), F.initcap(word(42)), F.initcap(word(43)), F.initcap(word(44)), quote, tail)
    bad = F.when(F.pmod(F.xxhash64("id", F.lit(45)), F.lit(8)) == 0, letters).when(F.pmod(F.xxhash64("id", F.lit(45)), F.lit(8)) == 1, phrase).otherwise(bad)
    uuid = F.concat_ws("-", part(h, 1, 8), part(h, 9, 4), part(h, 13, 4), part(h, 17, 4), part(h, 21, 12))
    digits = F.translate(h, "abcdef", "012345")
    harmless = F.get(
        F.array(
            F.concat(pick(10, "commit ", "revision ", "sha1 ", "checksum: ", "sha256:", "md5 = "), part(h, 1, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64)), size(11, 1, 3)))),
            F.concat(pick(12, "id ", "uuid=", "request ", "see ", "row "), uuid),
            F.concat(pick(13, "/", "src/", "https://host.example/", "./"), word(14), F.lit("/"), word(15), F.lit("_"), word(16), part(digits, 1, 2), pick(17, "", ".html", "/index", ".json")),
            F.concat(word(18), F.lit("_"), word(19), F.lit("_"), word(20), F.lit("_"), part(digits, 1, size(21, 1, 4))),
            F.concat(F.initcap(word(22)), F.initcap(word(23)), F.initcap(word(24)), part(digits, 5, 2), pick(25, "", "()", " = new", ":")),
            F.concat(pick(26, "card ", "order ", "number ", "phone ", "call "), part(digits, 1, size(27, 16, 20))),
            F.concat(name, sign, quote, pick(28, "xxxxxxxxxxxxxxxx1234", "your-token-here-0000", "1234567890123456", "example_password_1", "0000000000000000000", "aaaaaaaaaaaaaaaaaa1"), quote),
            F.concat(pick(46, "call ", "new ", "the ", "see "), word(47), F.initcap(word(48)), F.initcap(word(49)), F.initcap(word(50)), pick(51, "", "()", ":", ",")),
            F.concat(pick(52, "type: ", "class = ", "name=", "handler: "), word(47), F.initcap(word(48)), F.initcap(word(49)), F.initcap(word(50)), pick(51, "", "()", ";", ",")),
            F.concat(F.lit("https://"), word(29), F.lit(".example/"), word(30), F.lit("/"), part(h, 1, size(31, 16, 40)), pick(32, "", ".png", "/view")),
        ),
        F.pmod("id", F.lit(10)).cast("int"),
    )
    rows = spark.range(first, first + n, numPartitions=4).withColumn("half", F.col("id") % 2).withColumn("id", F.floor(F.col("id") / 2))
    return rows.select(F.when(F.col("half") == 1, bad).otherwise(harmless).alias("text"), F.col("half").cast("double").alias("secret"))


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """The forest, trained on labelled findings (text, secret)."""
    rows = candidates(findings.filter("secret IS NOT NULL").select("secret", "text")).select(F.col("secret").cast("double").alias("secret"), *features())
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="__x")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="secret", numTrees=trees, maxDepth=depth, seed=SEED, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y")
    data = assembler.transform(rows)
    if data.select("secret").distinct().count() < 2:
        raise ValueError("labelled findings must hold secrets and harmless candidates")
    return PipelineModel([assembler, forest.fit(data)])


def scan(df: DataFrame, model: PipelineModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, word_index, nth, value, score and secret of each candidate in ``text``."""
    found = candidates(df.select(column(doc_id).alias("__doc"), column(text).alias("__text")), "__text").select("__doc", "__f", *features())
    scored = model.transform(found).select("__doc", "__f", F.bround(vector_to_array("__p")[1], 9).alias("score"))
    return scored.select(F.col("__doc").alias(doc_id), "__f.word_index", "__f.nth", "__f.value", "score", (F.col("score") >= threshold).alias("secret"))


def op7(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), fit(labelled_findings(spark)))
