"""Secret findings in texts, with a random forest that removes false positives, native expressions only.

A candidate is a run of ``LEAST`` or more characters of keys and tokens. Its features are its length, the
share of changes between character classes, shares of digits, capitals and distinct characters, the part
that a dictionary covers, marks of a path, and words and signs beside it. The forest is trained on labelled
findings - by default ``findings``, which writes them by rule from hashes - and gives each candidate a
probability; those below ``threshold`` are reported as false positives.

Defined results: null, empty and short texts have no candidates; repeated rows have their findings each;
a null doc_id is kept; overlapping candidates do not exist; a candidate of any length is one finding. A finding
holds the sha256 of the candidate, not its text, and its place, so that a text can be redacted.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 20
CANDIDATE = r"[A-Za-z0-9_+/=\-]{" + str(LEAST) + ",}"
BESIDE = 40
TREES, DEPTH, SEED = 20, 6, 11
TRAINING = 4000
#: Common words of the four languages of the texts and of identifiers (fixed values).
DICTIONARY = (
    "the and for that with this from are was were has have not but his her they you all can had one our out new day get use man see way who its did "
    "ing tion ent ation ment able ness less over under ever which there their about after other than then them these those "
    "und der die das ein eine nicht mit sich auf für ist werden schen chen lich keit heit ung ver sch ich ieb "
    "les des une que pour dans par sur pas est avec elle ment eau aux oi eux "
    "los las una por con para como más pero sus este ción ado ido mente ar os "
    "user name file path data test config index module class value version main src lib bin home"
).split()
KEYWORDS = r"(api.?key|access.?key|secret|token|passw|pwd|auth|credential|private.?key|client.?key)"
HARMLESS = r"(commit|sha1|sha256|sha-|md5|checksum|digest|hash|uuid|guid|etag|revision|example|sample|build|integrity)"
FEATURES = ("f_length", "f_changes", "f_digits", "f_upper", "f_distinct", "f_dictionary", "f_slashes", "f_path", "f_assigned", "f_quoted", "f_keyword", "f_harmless")


def split_candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each candidate: doc_id, its number, its first character's place (from 1), itself and the text beside it."""
    some = docs.where(F.col(text).rlike(CANDIDATE)).select(F.col(doc_id).alias("doc_id"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split(text, CANDIDATE, -1).alias("p"))
    one = F.transform(
        F.sequence(F.lit(1), F.size("c")),
        lambda i: F.struct(
            i.alias("nth"),
            (F.aggregate(F.slice(F.transform("p", F.length), 1, i), F.lit(1), lambda a, x: a + x) + F.aggregate(F.slice(F.transform("c", F.length), 1, i - 1), F.lit(0), lambda a, x: a + x)).alias("start"),
            F.element_at("c", i).alias("candidate"),
            F.right(F.element_at("p", i), F.lit(BESIDE)).alias("before"),
            F.left(F.element_at("p", i + 1), F.lit(BESIDE)).alias("after"),
        ),
    )
    return some.select("doc_id", F.inline(one))


def features(found: DataFrame) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate")
    runs = c
    for kind, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), (r"[_+/=\-]+", "-")):
        runs = F.regexp_replace(runs, kind, sign)
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    left: Column = F.lower("before")
    share = lambda kind: 1 - F.length(F.regexp_replace(c, kind, "")) / n
    flag = lambda x: x.cast("double")
    return found.withColumns(
        {
            "f_length": n.cast("double"),
            "f_changes": (F.length(runs) - 1) / (n - 1),
            "f_digits": share("[0-9]"),
            "f_upper": share("[A-Z]"),
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(256)),
            "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(c), f"({words})", "")) / n,
            "f_slashes": F.length(F.regexp_replace(c, "[^/]", "")).cast("double"),
            "f_path": flag(left.rlike(r"(://|[/.~])[^\s]*$") | c.rlike(r"^/|/[a-z]+/")),
            "f_assigned": flag(F.col("before").rlike(r"""[=:]\s*["']?$""")),
            "f_quoted": flag(F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")),
            "f_keyword": flag(left.rlike(KEYWORDS)),
            "f_harmless": flag(left.rlike(HARMLESS)),
        }
    )


def findings(spark: SparkSession, rows: int = TRAINING) -> DataFrame:
    """Labelled findings written by rule: half are secrets in the places they leak from, half look alike but are hashes, paths, identifiers and long words."""
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), "id").cast("binary"), 256)
    number = lambda salt, n: (F.pmod(F.xxhash64(salt, F.col("id")), F.lit(n)) + 1).cast("int")
    pick = lambda salt, *xs: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), number(F.lit(salt), len(xs)))
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(h(salt))), "[=\r\n]", "")
    short = [w for w in DICTIONARY if w.isascii()][:100]
    words = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.element_at(F.array(*map(F.lit, short)), number(i, len(short))))
    length = number(F.lit("n"), 24) + LEAST - 1
    base = spark.range(rows).select("id", words.alias("w"), h("a").alias("h"), length.alias("n"))
    filler = F.concat_ws(" ", F.slice("w", 10, 3))
    name = pick("k", "token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "TOKEN", "apiKey", "credentials")
    sign = pick("s", ' = "', "=", ": ", "='", ' := "', ': "')
    good = base.where("id % 2 = 1").select(
        F.concat(filler, F.lit(" "), name, sign).alias("before"),
        pick("c", F.left("h", F.lit(40)), F.upper(F.left("h", F.lit(40))), F.left(b64("b"), F.col("n")), F.concat(F.lit("AKIA"), F.upper(F.left("h", F.lit(16)))), F.concat(F.lit("sk_live_"), F.left(b64("b"), F.lit(24))), F.col("h")).alias("candidate"),
        pick("a", '"', " ", "'", "\n", '" ').alias("after"),
        F.lit(1.0).alias("label"),
    )
    uuid = F.concat_ws("-", *(F.substring("h", i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    long_word = F.array_join(F.slice("w", 1, 9), "")
    hashes = pick("e", F.left("h", F.lit(40)), F.col("h"), uuid, F.md5("h"))
    words_ = pick("f", long_word, F.initcap(long_word), F.concat(F.lit("/"), F.array_join(F.slice("w", 1, 6), "/")), F.array_join(F.slice("w", 1, 7), "_"), F.lit("-" * 32), F.lit("x" * 28), long_word)
    label = pick("h", "commit ", "sha256: ", "md5=", "checksum = ", "uuid: ", "https://example.com/", 'etag="', "id ")
    after = pick("i", " ", ".", ",", "\n", "/index", '"')
    like = base.where("id % 4 = 0").select(F.concat(filler, F.lit(" "), label).alias("before"), hashes.alias("candidate"), after.alias("after"), F.lit(0.0).alias("label"))
    plain = base.where("id % 4 = 2").select(F.concat(filler, F.lit(" ")).alias("before"), words_.alias("candidate"), after.alias("after"), F.lit(0.0).alias("label"))
    found = good.unionByName(like).unionByName(plain)
    return found.withColumn("candidate", F.rpad("candidate", F.greatest(F.length("candidate"), F.lit(LEAST)), "a"))


def assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found))


def train(labelled: DataFrame, *, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, labelCol="label").fit(assembled(labelled).select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, nth, start, length, sha256, probability and is_secret of each candidate."""
    scored = model.transform(assembled(split_candidates(docs, doc_id=doc_id, text=text)))
    p = vector_to_array("probability")[1]
    return scored.select("doc_id", "nth", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("sha256"), p.alias("probability"), (p >= threshold).alias("is_secret"))
