"""Secret scan with a random forest against false positives, with DataFrame functions only.

Candidates are found by patterns over whole texts: values assigned to a credential name, passwords
in URLs, known key prefixes, and long runs of letters and digits mixed. Each candidate gets features: length,
shares and entropy of its characters, transitions (how often the character class changes, and how
usual its letter pairs are in the corpus), dictionary coverage (letters that lie in words of the
corpus), its path (the source of the document), and the words beside it. A random forest
trained on labelled findings decides which candidates are secrets.

Corpus statistics cover all documents: word counts by one aggregation with partial sums; letter
pairs are at most 27 x 27 numbers. The forest is fitted on at most ``TRAIN_ROWS`` labelled
findings, taken in hash order; everything else covers every row.

Defined results: null and empty texts have no candidates; repeated rows give the same findings;
candidates do not overlap; without labelled findings of both kinds nothing can be learned and the
weak label itself decides; an empty table gives no rows; other columns are passed on by
``redact``. A missing source is an empty path.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import text_of
from tidegauge.session import cut_lineage

NAMES = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
BLOCK = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----"
#: Keys that show their issuer by a prefix.
ISSUED = (
    "AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{30,}|github_pat_\\w{22,}|xox[a-z]-[A-Za-z0-9-]{10,}"
    + "|eyJ[\\w-]{8,}\\.[\\w-]{8,}\\.[\\w-]{8,}|AIza[\\w-]{30,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}"
    + "|glpat-[\\w-]{20,}|hf_[A-Za-z0-9]{30,}|pypi-[\\w-]{40,}|shp[a-z]{2}_[0-9a-fA-F]{32}|sk-(?=[A-Za-z_-]{0,64}[0-9])[\\w-]{20,}"
)
#: What stands before a value: a credential name with its assignment, or the user of a URL.
ASSIGNED = "(?i:" + NAMES + ")[A-Za-z_]{0,20}[\"']?[ \\t]{0,4}[:=][ \\t]{0,4}[\"']?"
USER = "://[^\\s/:@\"']*+:"
VALUE = "[^\\s\"'|,;]{6,}"
NO_NAME = "(?![A-Za-z0-9_-]{0,64}" + ASSIGNED + VALUE + ")"  # a run that ends as the name of an assigned value
#: One alternative for each kind of candidate; the value is what follows the assignment or the user.
#: A run begins with its first sign, whatever stands before its first digit; the last alternative
#: takes what an issued key leaves of a run.
PATTERN = (
    "(?:" + ASSIGNED + "(?![A-Za-z][A-Za-z0-9+.-]*+" + USER + "[^\\s/\"'<>]+@)" + VALUE
    + "|" + USER + "[^\\s/\"'<>]+(?=@)"
    + "|" + BLOCK
    + "|\\b(?:" + ISSUED + ")"
    + "|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])" + NO_NAME + "[A-Za-z0-9+/_=-]{16,}"
    + "|\\b(?=[A-Za-z]{0,64}[0-9])" + NO_NAME + "[A-Za-z0-9+/_=-]{16,}"
    + ")"
)
NAMED = "^(?:" + ASSIGNED + "|" + USER + ")"
KNOWN = "^(?:" + ISSUED + "|-----BEGIN)"
NEAR = 48  # characters beside a candidate that give the neighbouring words
TRAIN_ROWS = 20_000
COMMON = 25  # occurrences that make a word a dictionary word
MASK = "[SECRET]"
FEATURES = (
    "length", "digit_share", "upper_share", "hex_share", "entropy", "class_changes", "pair_rarity",
    "dictionary_coverage", "named", "known_form", "near_secret", "near_example", "path_test", "path_depth",
)


def found_in(text: Column) -> Column:
    """Array of (start, match, before, after) of the candidates of a text, in order."""
    matches = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    rest = F.split(text, PATTERN, -1)
    empty = F.array().cast("array<struct<start:int,match:string,before:string,after:string>>")
    built = F.aggregate(
        F.sequence(F.lit(0), F.size(matches) - 1),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get(rest, i)) + F.length(F.get(matches, i))).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(F.get(rest, i))).alias("start"),
                        F.get(matches, i).alias("match"),
                        F.right(F.get(rest, i), F.lit(NEAR)).alias("before"),
                        F.left(F.get(rest, i + 1), F.lit(NEAR)).alias("after"),
                    )
                ),
            ).alias("out"),
        ),
    )["out"]
    return F.when(F.size(matches) > 0, built).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row_no, path, start, value, before, after, named of every candidate, stored."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_no"),
        F.coalesce(source, F.lit("")).alias("path"),
        text_of().alias("text"),
    )
    hits = rows.select("doc_id", "row_no", "path", F.explode(found_in(F.col("text"))).alias("c"))
    name = F.regexp_extract("c.match", NAMED, 0)
    return cut_lineage(
        hits.select(
            "doc_id",
            "row_no",
            "path",
            (F.col("c.start") + F.length(name)).cast("long").alias("start"),
            F.substring(F.col("c.match"), F.length(name) + 1, F.length("c.match")).alias("value"),
            F.concat(F.col("c.before"), name).alias("before"),
            F.col("c.after").alias("after"),
            (F.length(name) > 0).alias("named"),
        )
    )


def dictionary(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(word, n): lower-case words of letters that occur at least ``common`` times, stored."""
    words = docs.select(F.explode(F.split(F.lower(text_of()), "[^a-z]+")).alias("word"))
    counts = words.filter(F.length("word") >= 2).groupBy("word").agg(F.count("*").alias("n"))
    return cut_lineage(counts.filter(F.col("n") >= common))


def letter_pairs(words: DataFrame) -> dict[str, float]:
    """-log of the share of each letter pair after its first letter; at most 26 x 26 entries."""
    pair = words.select("n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    pair = pair.select("n", F.substring(F.col("word"), F.col("i"), F.lit(2)).alias("pair"))
    sums = pair.groupBy("pair").agg(F.sum("n").alias("n"))
    total = sums.groupBy(F.substring("pair", 1, 1).alias("head")).agg(F.sum("n").alias("all"))
    rarity = -F.ln(F.col("n") / F.col("all"))
    rows = sums.withColumn("head", F.substring("pair", 1, 1)).join(total, "head").select("pair", rarity.alias("r")).collect()
    return {r.pair: r.r for r in rows}


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(value, covered): share of a value's characters that lie in dictionary words of 3 letters or more."""
    values = found.select("value").distinct()
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), 0)).alias("word"))
    known = runs.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("letters"))
    return known.select("value", (F.col("letters") / F.length("value")).alias("covered"))


def featured(found: DataFrame, words: DataFrame, rarity: dict[str, float]) -> DataFrame:
    """Candidates with the columns of ``FEATURES``."""
    value, n = F.col("value"), F.length("value")

    def share(signs: str) -> Column:
        return F.length(F.regexp_replace(value, f"[^{signs}]", "")) / n

    chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(value, i, F.lit(1)))
    entropy = F.aggregate(
        F.array_distinct(chars),
        F.lit(0.0),
        lambda acc, c: acc - F.log2((n - F.length(F.replace(value, c, F.lit("")))) / n) * ((n - F.length(F.replace(value, c, F.lit("")))) / n),
    )
    kinds = value
    for signs, kind in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^aA0]", "-")):
        kinds = F.regexp_replace(kinds, signs, kind)
    changes = F.length(F.regexp_replace(kinds, "(.)\\1*", "#")) - 1
    table = F.create_map(*[F.lit(x) for kv in sorted(rarity.items()) for x in kv]) if rarity else F.create_map().cast("map<string,double>")
    low = F.lower(value)
    pairs = F.when(n < 2, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(table[F.substring(low, i, F.lit(2))], F.lit(12.0))) / (n - 1)
    )
    near = F.lower(F.concat_ws(" ", "before", "after"))
    flag = lambda c: c.cast("double")
    return found.join(coverage(found, words), "value", "left").select(
        *found.columns,
        n.cast("double").alias("length"),
        share("0-9").alias("digit_share"),
        share("A-Z").alias("upper_share"),
        share("0-9a-fA-F").alias("hex_share"),
        entropy.alias("entropy"),
        (changes / n).alias("class_changes"),
        pairs.alias("pair_rarity"),
        F.coalesce("covered", F.lit(0.0)).alias("dictionary_coverage"),
        flag(F.col("named")).alias("named_"),
        flag(value.rlike(KNOWN)).alias("known_form"),
        flag(near.rlike(NAMES)).alias("near_secret"),
        flag(near.rlike("example|sample|dummy|placeholder|test|fake|changeme")).alias("near_example"),
        flag(F.lower("path").rlike("test|spec|example|fixture|mock|doc")).alias("path_test"),
        F.size(F.split("path", "/")).cast("double").alias("path_depth"),
    )


def weak_label(named: Column, value: Column, near: Column) -> Column:
    """Label of a finding where no reviewed one is given: 1 for a value of a known key form, or one
    assigned to a credential name or standing as a URL's password that mixes digits with letters,
    or both cases with other signs, at any length; 0 otherwise, for calls and look-ups of code,
    and where the words beside it say that it is an example."""
    known = value.rlike(KNOWN)
    mixed = value.rlike("[A-Za-z]") & (value.rlike("[0-9]") | (value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[^A-Za-z0-9._/-]")))
    code = value.rlike("^[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*[\\[(]|^\\{\\{|^%\\(")
    example = F.lower(near).rlike("example|sample|dummy|placeholder|changeme") | F.lower(value).rlike("^(x+|\\*+|<.*>|\\$\\{.*)$")
    return ((known | (named & mixed & ~code)) & ~example).cast("double")


def scan(docs: DataFrame, labelled: DataFrame | None = None, trees: int = 20, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every candidate with its score and verdict.

    ``labelled`` has reviewed findings: path, value, before, after, named, label (0 or 1). Where
    it is not given, candidates of the corpus itself with their weak labels serve.
    Returns doc_id, row_no, start, length, value_sha256, kind, score, is_secret.
    """
    found = candidates(docs)
    words = dictionary(docs)
    rarity = letter_pairs(words)
    near = F.concat_ws(" ", "before", "after")
    every = cut_lineage(featured(found, words, rarity).withColumn("weak", weak_label(F.col("named"), F.col("value"), near)))
    inputs = [f if f != "named" else "named_" for f in FEATURES]
    if labelled is None:
        known = every.withColumn("label", F.col("weak"))
    else:
        known = featured(labelled.withColumn("row_no", F.lit(None).cast("long")), words, rarity)
    # Half of the sample for each kind, in hash order: the sample is bounded and repeatable.
    order = [F.xxhash64("value", "before", "after"), F.col("value")]
    halves = [known.filter(F.col("label") == k).orderBy(*order).limit(train_rows // 2) for k in (0.0, 1.0)]
    sample = cut_lineage(halves[0].unionByName(halves[1]).select(*inputs, "label"))
    kinds = sample.groupBy("label").count().collect()
    assembled = VectorAssembler(inputCols=inputs, outputCol="_features")
    if len(kinds) == 2:
        forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=6, seed=17)
        model = forest.fit(assembled.transform(sample))
        scored = model.transform(assembled.transform(every)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = every.withColumn("score", F.col("weak"))
    kind = F.when(F.col("known_form") > 0, F.lit("known form")).when(F.col("named"), F.lit("assignment")).otherwise(F.lit("run"))
    return scored.select(
        "doc_id",
        "row_no",
        "start",
        F.col("length").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        kind.alias("kind"),
        F.round("score", 9).alias("score"),
        (F.col("score") >= 0.5).alias("is_secret"),
    )


def redact(docs: DataFrame, labelled: DataFrame | None = None, mask: str = MASK) -> DataFrame:
    """The documents with every secret replaced by ``mask``; n_chars, where there is one, follows.

    The rows are stored first, so that their numbers are the same at each reading.
    """
    docs = cut_lineage(docs)
    spans = (
        scan(docs, labelled)
        .filter("is_secret")
        .groupBy(F.col("row_no").alias("_tg_row"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("_tg_spans"))
    )
    joined = docs.withColumn("_tg_row", F.monotonically_increasing_id()).join(spans, "_tg_row", "left")
    text = F.col("text")
    cut = F.aggregate(
        "_tg_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            (s["start"] + s["length"]).alias("at"),
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    changed = F.col("_tg_spans").isNotNull()
    out = joined.withColumn("_tg_text", F.when(changed, cut).otherwise(text))
    columns = []
    for c in docs.columns:
        column = F.col(f"`{c}`")
        if c == "text":
            column = F.col("_tg_text")
        elif c == "n_chars":
            column = F.when(changed, F.length("_tg_text").cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return out.select(*columns)
