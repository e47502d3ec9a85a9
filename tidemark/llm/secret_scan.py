"""Secrets in texts: wide patterns propose candidates, a random forest turns down false ones.

Candidates: every run of at least MIN_CHARS letters, digits and + / = _ - . that holds a digit (and doesn't begin with such an assignment as follows); every such run of MIN_PREFIXED after
the prefix of a known kind of key; every value of at least MIN_VALUE characters that a word such as password is set to by = or a colon;
and every private-key header. Features of a candidate: its length, its classes of characters and the changes
between them, how likely each letter follows the one before in the corpus, how much of it the corpus's own words cover, its
path (or source), and the words before and after it. Words and letter pairs are counted over all documents; the DICTIONARY_WORDS most frequent
words of letters and the 26 x 26 pairs reach the driver. The forest is trained from labelled findings (a
DataFrame of before, candidate, after, path, label, of which at most max_rows are taken, by a hash of the row); without any, from
findings made by a seeded generator of keys and of what is mistaken for them: digests of files, identifiers,
numbers, dates, paths, names, placeholders. That sample has TRAIN_ROWS rows, a fixed bound.

All is DataFrame functions and Spark's own forest. Counts of rows never change: each candidate gets its row. Positions count
code points from 0. Defined cases: null and empty texts have no candidates; a null path counts as empty; rows that repeat an id repeat
their findings; candidates of any length are judged whole; a corpus without words has an empty dictionary and even letter pairs.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, read, text_or_empty

MIN_CHARS, MIN_PREFIXED, MIN_VALUE, NEIGHBOUR, TRAIN_ROWS, THRESHOLD = 16, 12, 6, 40, 6000, 0.5
DICTIONARY_WORDS = 5000
#: Positions are summed in blocks of so many candidates, so that their cost stays near linear.
BLOCK = 256
#: Fixed values.
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "ya29.", "eyJ", "SG.", "npm_", "pypi-", "dop_v1_"]
KEY_WORDS = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private", "credential", "auth", "bearer", "key"]
VALUE_WORDS = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "private_key", "credential", "credentials"]
OTHER_WORDS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "integrity", "hash", "uuid", "guid", "revision", "version", "example", "sample", "test", "dummy", "placeholder", "http", "www", "isbn", "phone", "card", "order", "id"]
PLACEHOLDERS = ["your", "here", "example", "sample", "change", "replace", "insert", "dummy", "placeholder", "redact", "xxxx", "test", "todo", "none", "null", "required", "optional"]
_SET = "A-Za-z0-9+/=_.-"
#: Three looks back: most places fail at the first or second, which cost little.
_SET_TO = "(?<=[=:\\s\"'`])(?<=[=:]\\s{0,3}[\"'`]?)(?<=(?i:" + "|".join(VALUE_WORDS) + ")[\"'`]?\\s{0,3}[=:]\\s{0,3}[\"'`]?)"
CANDIDATE = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----"
    + rf"|{_SET_TO}[^\s\"'`<>,;]{{{MIN_VALUE},}}+"
    + rf"|(?<![{_SET}])(?:(?:{'|'.join(p.replace('.', '[.]') for p in PREFIXES)})[{_SET}]{{{MIN_PREFIXED},}}+|(?=[{_SET}]{{{MIN_CHARS}}})(?![A-Za-z0-9_.-]*(?i:{'|'.join(VALUE_WORDS)})=)[A-Za-z+/=_.-]*+[0-9][{_SET}]*+)"
)
FEATURES = ["length", "digits", "uppers", "lowers", "signs", "others", "hexes", "changes", "pairs", "words", "distinct", "prefix", "assigned", "quoted", "key_before", "other_before", "other_after", "path_test", "placeholder", "template", "location", "only_letters", "only_digits", "only_hex", "dashes", "longest_letters", "pem"]


def lexicon(docs: DataFrame, text_col: str = "text") -> tuple[list[str], list[float]]:
    """The corpus's most frequent words of 3 to 20 letters a-z (ties by the word), and log2 P(next letter | letter) for 26 x 26 pairs, over all its words."""
    word = F.explode(F.split(F.regexp_replace(ascii_lower(text_or_empty(f"`{text_col}`")), "[^a-z]+", " "), " "))
    counted = checkpointed(docs.select(word.alias("w")).filter(F.char_length("w").between(2, 20)).groupBy("w").count())
    # Checkpointed, as a limit that is collected directly sends so many rows of every partition to the driver.
    top = [r["w"] for r in checkpointed(counted.filter(F.char_length("w") > 2).orderBy(F.desc("count"), "w").limit(DICTIONARY_WORDS)).collect()]
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("w") - 1), lambda i: F.substring("w", i, F.lit(2))))
    seen = np.zeros((26, 26))
    for r in counted.select(pair.alias("p"), "count").groupBy("p").agg(F.sum("count").alias("n")).collect():  # at most 676 rows
        seen[ord(r["p"][0]) - 97, ord(r["p"][1]) - 97] = r["n"]
    return top, np.log2((seen + 1) / (seen + 1).sum(axis=1, keepdims=True)).round(6).ravel().tolist()


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, candidate, before, after, path: a row for each candidate."""
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("ss_text"), path.alias("path"))
    both = F.struct(F.regexp_extract_all("ss_text", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split("ss_text", CANDIDATE, -1).alias("gaps"))
    # The generator keeps the two arrays as columns; else every use below would match the text again, inside the lambdas for each candidate.
    found = rows.filter(F.col("ss_text").rlike(CANDIDATE)).select("doc_id", "path", F.explode(F.array(both)).alias("b")).select("doc_id", "path", "b.hits", "b.gaps")
    # The k-th candidate stands between the k-th and the next gap. Its start: the lengths before its block, and those before it in the block.
    sizes = F.transform("gaps", lambda g, i: F.struct(F.char_length(g).cast("long").alias("gap"), F.coalesce(F.char_length(F.get("hits", i)), F.lit(0)).cast("long").alias("hit")))
    found = found.select("*", F.explode(F.array(F.slice(sizes, F.lit(1), F.size("hits")))).alias("sizes"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / BLOCK).cast("int")), lambda b: F.slice("sizes", b * BLOCK + 1, F.lit(BLOCK)))
    found = found.select("*", F.explode(F.array(blocks)).alias("blocks"))
    start = lambda rows, size: F.aggregate(
        rows, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all")),
        lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"],
    )
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["hit"])
    found = found.select("*", F.explode(F.array(start(F.transform("blocks", total), lambda n: n))).alias("firsts"))
    within = lambda block: F.zip_with(start(block, lambda x: x["gap"] + x["hit"]), block, lambda a, x: a + x["gap"])
    sums = F.flatten(F.zip_with("blocks", "firsts", lambda block, first: F.transform(within(block), lambda a: first + a)))
    one = found.select("doc_id", "path", F.arrays_zip(sums.alias("start"), F.col("hits").alias("candidate"), F.transform(F.slice("gaps", F.lit(1), F.size("hits")), lambda g: F.right(g, F.lit(NEIGHBOUR))).alias("before"), F.transform(F.slice("gaps", F.lit(2), F.size("hits")), lambda g: F.left(g, F.lit(NEIGHBOUR))).alias("after")).alias("z"))
    return one.select("doc_id", "path", F.inline("z")).toDF("doc_id", "path", "start", "candidate", "before", "after")


def _share(c: Column, pattern: str) -> Column:
    """Characters of c that match, by its length."""
    return (F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))) / F.greatest(F.char_length(c), F.lit(1))


def _any(c: Column, words: list[str]) -> Column:
    return ascii_lower(c).rlike("(?:" + "|".join(words) + ")").cast("double")


def featured(found: DataFrame, words: list[str], pairs: list[float]) -> DataFrame:
    """found (before, candidate, after, path) with FEATURES as doubles; words, pairs: the corpus's lexicon."""
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    n, low = F.greatest(F.char_length(c), F.lit(1)), ascii_lower(c)
    # The generator keeps these as columns, so that the lambdas don't make them for each of their elements.
    runs = F.split(F.regexp_replace(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " "), "[^A-Za-z]+", " "), " ")
    kept = found.select("*", F.explode(F.array(F.struct(F.split(low, "").alias("chars"), F.transform(runs, ascii_lower).alias("runs"), F.split(F.lit(",".join(map(repr, pairs))), ",").cast("array<double>").alias("pairs")))).alias("ss"))
    at = F.transform("ss.chars", lambda x: F.ascii(x) - 97)
    follows = F.zip_with(F.slice(at, F.lit(1), F.size("ss.chars") - 1), F.slice(at, F.lit(2), F.size("ss.chars")), lambda a, b: F.when(a.between(0, 25) & b.between(0, 25), a * 26 + b))
    likely = F.filter(follows, lambda i: i.isNotNull())
    mean = F.aggregate(likely, F.lit(0.0), lambda a, i: a + F.get("ss.pairs", i)) / F.greatest(F.size(likely), F.lit(1))
    # One literal a length, folded into the plan as an array: thousands of them would weigh on every plan.
    by_length = F.array(*[F.split(F.lit(" ".join(w for w in words if len(w) == n_chars)), " ") for n_chars in range(21)])
    covered = F.aggregate("ss.runs", F.lit(0), lambda a, x: a + F.when(F.char_length(x).between(1, 20) & F.array_contains(F.get(by_length, F.char_length(x)), x), F.char_length(x)).otherwise(0))
    values = {
        "length": F.char_length(c), "digits": _share(c, "[0-9]"), "uppers": _share(c, "[A-Z]"), "lowers": _share(c, "[a-z]"), "signs": _share(c, "[^A-Za-z0-9]"), "others": _share(c, f"[^{_SET}]"), "hexes": _share(c, "[0-9a-fA-F]"),
        "changes": F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n,
        "pairs": F.when(F.size(likely) > 0, mean).otherwise(-8.0), "words": covered / n,
        "distinct": F.size(F.array_distinct("ss.chars")) / F.least(n, F.lit(64)),
        "prefix": c.rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")"), "assigned": before.rlike(r"[=:]\s*[\"']?$"), "quoted": before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"),
        "key_before": _any(F.right(before, F.lit(24)), KEY_WORDS), "other_before": _any(before, OTHER_WORDS), "other_after": _any(after, OTHER_WORDS), "path_test": _any(F.col("path"), ["test", "example", "sample", "doc", "fixture", "mock"]),
        "placeholder": _any(c, PLACEHOLDERS), "template": c.rlike(r"[(){}$%\[\]]"), "location": c.rlike(r"^(?:[a-z]+:|\.{0,2}/|www\.)") | c.rlike(r"\.[a-z]{2,7}$"),
        "only_letters": c.rlike(r"^[A-Za-z]+[.!?]?$"), "only_digits": c.rlike(r"^[0-9.-]+$"), "only_hex": c.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$"), "dashes": F.regexp_count(c, F.lit("[-_./]")) / n, "longest_letters": F.array_max(F.transform("ss.runs", lambda x: F.char_length(x))), "pem": c.startswith("-----BEGIN"),
    }
    return kept.select(*[F.col(f"`{x}`") for x in found.columns], *[F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(f"ss_{k}") for k in FEATURES])


#: Pieces that made words and sentences are put together from.
PIECES = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea"]


def made_findings(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, str, str, str, float]]:
    """before, candidate, after, path, label: keys as they stand in texts (1) and what is mistaken for them (0)."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    word = lambda n: "".join(r.choice(PIECES) for _ in range(n))
    prose = lambda: " ".join(word(r.randint(1, 4)) for _ in range(6))
    out = []
    while len(out) < rows:
        left, right, path = prose()[-28:] + " ", r.choice([" ", "\n"]) + prose()[:30], r.choice(["src1", "src0", "app/main.py", "web", "wiki", "deploy/prod.env", "tests/test_auth.py", ""])
        kind = r.randrange(24)
        assign = r.choice(['{} = "', "{}='", "{}: ", "{}=", '"{}": "', "{} = ", "export {}="])
        closing = '"' if '"' in assign[-1:] else "'" if assign.endswith("'") else ""
        name = r.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "TOKEN", "SECRET_KEY", "private_key", "passwd", "api-key", "Password", "db_password"])
        add = lambda body, y, before="", after="": out.append((left + before, body, after + right, path, y))
        if kind < 5:
            body = [lambda: pick(hexes, r.choice([32, 40, 40, 64])), lambda: pick(alnum, r.randint(16, 48)), lambda: pick(b64, r.randint(24, 60)) + "7" + r.choice(["", "=", "=="]), lambda: pick(alnum + "_-", r.randint(16, 40)), lambda: pick(string.ascii_letters, r.randint(16, 40))][r.randrange(5)]()
            add(body, 1.0, r.choice([assign, assign, "{} is "]).format(name) if any(x.isdigit() for x in body) else assign.format(name), closing)
        elif kind < 8:
            prefix, size = r.choice([("AKIA", 16), ("ghp_", 36), ("glpat-", 20), ("xoxb-", 40), ("sk-", 40), ("sk_live_", 24), ("AIza", 35), ("npm_", 36), ("eyJ", 60), ("SG.", 60)])
            chars = string.ascii_uppercase + "234567" if prefix == "AKIA" else r.choice([alnum, alnum, string.ascii_letters])
            add(prefix + pick(chars, size), 1.0, r.choice(["", assign.format(name)]))
        elif kind == 8:
            add(f"-----BEGIN {r.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----", 1.0, "", "\n" + pick(b64, 30))
        elif kind < 12:  # short passwords, with and without digits and signs
            body = [lambda: word(r.randint(2, 4)).title() + pick("0123456789", r.randint(1, 4)) + pick("!@#$%&*", r.randint(0, 2)), lambda: pick(alnum + "!@#$%^&*", r.randint(8, 15)), lambda: word(2) + r.choice("!@#-_") + word(2) + pick("0123456789", r.randint(0, 3))][r.randrange(3)]()
            add(body, 1.0, assign.format(r.choice(["password", "passwd", "pwd", "db_password", "Password", "secret"])), closing)
        elif kind < 14:
            add(pick(hexes, r.choice([32, 40, 40, 64])), 0.0, r.choice(["commit ", "sha256: ", "sha1 = ", "md5=", "checksum: ", "digest: ", "sha256-", "revision ", "hash: ", "git revert ", "build id "]))
        elif kind == 14:
            add("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), 0.0, r.choice(["id: ", "uuid=", "request ", ""]))
        elif kind == 15:
            add(pick("0123456789", r.randint(16, 22)), 0.0, r.choice(["", "card ", "order ", "account ", "isbn "]))
        elif kind == 16:
            add(r.choice(["your_api_key_here_1", "changeme-password-123", "example-secret-key-1", "xxxxxxxxxxxxxxxx1", "replace_with_your_token_1", "test_token_12345678", "dummy-value-0123456789", "my-sample-password-1", "0000000000000000", "1234567890123456", "insert-token-here-2", "changeme", "<redacted>", "********", "xxxxxxxx", "required", "your-token-here", "YOUR_API_KEY", "placeholder"]), 0.0, assign.format(name), closing)
        elif kind == 17:  # values that aren't secrets: code, variables, locations, prose
            add(r.choice(["${" + name.upper() + "}", "{{" + name + "}}", f"os.environ[{name}]", f"get_{name}()", f"config.{word(3)}.{name}", f"https://{word(3)}.example.org/{word(2)}", f"/etc/{word(3)}/{name}", f"%({name})s", f"{word(3)}.{word(2)}()", f"self.{name}", "process.env." + name.upper(), "string", "function", "undefined"]), 0.0, assign.format(name), closing)
        elif kind == 18:
            add(word(r.randint(3, 5)) + r.choice(["", ".", "", "!"]), 0.0, r.choice(["{}: ", "{} : ", "{}:\n"]).format(name), "")
        elif kind == 19:
            add(f"{word(3)}.example.{r.choice(['com', 'org'])}/{word(2)}/{r.randint(1, 9999)}", 0.0, r.choice(["https://", "www.", "see http://", "/"]))
        elif kind < 22:
            add(r.choice(["2024-01-31T12:30:45.000", "v1.2.3-beta.4+build.5", f"{word(4)}_{word(3)}{r.randint(1, 99)}", f"{word(4)}-{word(4)}-{r.randint(1, 2000)}", f"{word(5)}.{r.randint(1, 99)}", f"{r.randint(1, 254)}.{r.randint(10, 254)}.{r.randint(100, 254)}.{r.randint(100, 254)}", f"{word(6)}{r.randint(1, 9)}", f"{word(3)}={word(3)}{r.randint(1, 99)}"]), 0.0)
        elif kind == 22:
            add(f"{word(3)}/{word(3)}/{word(2)}_{r.randint(1, 99)}.{r.choice(['py', 'txt', 'html', 'parquet'])}", 0.0, r.choice(["/usr/", "", "./"]))
        else:
            add("".join(word(r.randint(2, 4)).title() for _ in range(3)) + str(r.randint(1, 99)), 0.0)
    return out


def train(spark: SparkSession, words: list[str], pairs: list[float], findings: DataFrame | None = None, max_rows: int = 100_000, trees: int = 30, depth: int = 10, seed: int = 5) -> RandomForestClassificationModel:
    """The forest, from labelled findings or made ones. Of more than max_rows those of the smallest hash are taken; rows without candidate or label tell nothing."""
    names = ["before", "candidate", "after", "path", "label"]
    if findings is None:
        findings = spark.createDataFrame(made_findings(), "before string, candidate string, after string, path string, label double")
        max_rows = TRAIN_ROWS
    known = findings.select(*names).filter(F.col("candidate").isNotNull() & F.col("label").isNotNull()).orderBy(F.xxhash64(*names), *names).limit(max_rows)
    rows = VectorAssembler(inputCols=[f"ss_{k}" for k in FEATURES], outputCol="ss_features").transform(featured(known, words, pairs)).select("ss_features", F.col("label").cast("double").alias("label")).persist()
    model = RandomForestClassifier(featuresCol="ss_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    rows.unpersist()
    return model


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD, max_rows: int = 100_000) -> DataFrame:
    """doc_id, start, length, candidate, score (probability of a secret), is_secret: a row for each candidate."""
    words, pairs = lexicon(docs, text_col)
    model = train(docs.sparkSession, words, pairs, findings, max_rows)
    rows = VectorAssembler(inputCols=[f"ss_{k}" for k in FEATURES], outputCol="ss_features").transform(featured(candidates(docs, id_col, text_col, path_col), words, pairs))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(rows).select("doc_id", "start", F.char_length("candidate").cast("long").alias("length"), "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of its document replaced by mark; a document's own secrets are gathered, no more."""
    secrets = found.filter("is_secret").groupBy(F.col("doc_id").alias("ss_id")).agg(F.array_sort(F.collect_set("candidate")).alias("ss_all"))
    met = docs.join(secrets, F.col(f"`{id_col}`").eqNullSafe(F.col("ss_id")), "left")
    clean = F.aggregate(F.coalesce("ss_all", F.array().cast("array<string>")), F.col(f"`{text_col}`"), lambda t, s: F.replace(t, s, F.lit(mark)))
    return met.withColumn(text_col, clean).drop("ss_id", "ss_all")


def op9_secret_scan(spark, sf_dir: str, findings: DataFrame | None = None) -> DataFrame:
    """The candidates themselves stay in the operator; the query carries their digest. findings: labelled ones to train on."""
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), findings)
    return out.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
