"""Secret scan: broad candidates, then a random forest that removes false positives.

Everything on the main path is DataFrame and Spark ML work inside the JVM.  Candidates are values assigned or quoted,
values after a secret word, long character runs with a digit, and longer ones of mixed case; the forest decides which of
them are secrets.  Features: length, character classes and their transitions, the log-probability of letter transitions and the
coverage by a dictionary (both from the words of the whole corpus), the path, and the neighbouring words with their
log-odds among labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import stored

RUN = "[A-Za-z0-9_+/\\-]"
#: What a password may hold beside: any sign but white space, quotes, brackets and list signs; no sentence mark ends it.
SIGNED = "[^\\s\"'`<>(){}\\[\\],;|]{7,}(?<![.:?])[^\\s\"'`<>(){}\\[\\],;|.:?]"
#: After an assignment sign, a quote or a secret word: 8 or more signs, none of them needs to be a digit.  Not addresses.
#: The first look back, at one sign, spares most places the longer one.
NAMED = ("(?<=[=:\"'` \t])(?=[^\\s\"'`<>(){}\\[\\],;|]{8})"
         "(?<=[=:][ \t]{0,2}|[=:][ \t]{0,2}[\"'`]|[ \t][\"'`]|(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken)[ \t](?:is[ \t])?)"
         f"(?![=:/]|[A-Za-z]+://|www[.]){SIGNED}")
#: A run of 8 or more characters that holds a digit, with up to two padding signs.
DIGITS = f"(?<!{RUN})(?=[A-Za-z_+/\\-]*+[0-9]){RUN}{{8,}}+={{0,2}}"
#: A run of 16 or more without a digit that changes from lower to upper case twice or more.
MIXED = f"(?<!{RUN})(?=(?:[A-Z_+/\\-]*+[a-z]++[a-z_+/\\-]*+[A-Z]){{2}}){RUN}{{16,}}+={{0,2}}"
CANDIDATE = f"{NAMED}|{DIGITS}|{MIXED}"
#: Characters kept of the text before and after a candidate.
CONTEXT = 64
#: Labelled findings that the forest is fitted on at most, in hash order.
TRAIN_ROWS = 20_000
#: Occurrences from which a corpus word is in the dictionary.
DICTIONARY_COUNT = 20
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
FEATURES = [
    "length", "digits", "uppers", "lowers", "signs", "switches", "distinct", "letter_odds", "covered", "padding",
    "path_depth", "path_sample", "path_bucket", "assigned", "quoted", "prev_odds", "next_odds", "prev_bucket", "next_bucket"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``(id, rid, start, value, before, after, path)`` of every candidate of every whole text; ``start`` in code points."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), path.alias("path"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.select("id", "rid", "path", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("t", CANDIDATE, -1).alias("gaps"))
    each = F.transform("found", lambda v, i: F.struct(
        v.alias("value"), F.char_length(F.get("gaps", i)).alias("gap"), F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("before"),
        F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after")))
    # an outer explode: else its inferred filter would run the patterns a second time
    found = rows.select("id", "rid", "path", F.posexplode_outer(each).alias("n", "c")).filter("n is not null").select("id", "rid", "path", "n", "c.*")
    ended = F.sum(F.col("gap") + F.char_length("value")).over(Window.partitionBy("rid").orderBy("n"))
    return found.withColumn("start", (ended - F.char_length("value")).cast("long")).drop("gap", "n")


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of three ASCII letters or more that the whole corpus holds DICTIONARY_COUNT times or more."""
    words = docs.select(F.explode_outer(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("word")).filter("length(word) >= 3")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= DICTIONARY_COUNT)


def _bigrams(word: Column) -> Column:
    """Pairs of neighbouring letters."""
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.substr(word, i, F.lit(2)))


def letter_transitions(words: DataFrame) -> DataFrame:
    """``(pair, logp)``: log-probability of a letter after another in the corpus; at most 26 x 26 rows."""
    pairs = words.select("n", F.explode(_bigrams(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.left("pair", F.lit(1)).alias("a")).agg(F.sum("n").alias("total"))
    return pairs.withColumn("a", F.left("pair", F.lit(1))).join(F.broadcast(first), "a").select(
        "pair", F.log(F.col("n") / (F.col("total") + 26)).alias("logp"))


def features(found: DataFrame, words: DataFrame, odds: DataFrame) -> DataFrame:
    """Candidates with the FEATURES columns (but the neighbours' odds come from ``odds``: side, word, odds)."""
    v, n = F.col("value"), F.char_length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    kinds = ["[0-9]", "[A-Z]", "[a-z]", "[_+/=\\-]"]
    change = "|".join(f"(?<={a})(?={b})" for a in kinds for b in kinds if a != b)
    found = found.withColumn("cid", F.struct("rid", "start"))
    plain = found.select(
        "*", n.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[a-z]").alias("lowers"),
        share("[_+/\\-]").alias("signs"), share(change).alias("switches"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct"), F.regexp_count(v, F.lit("=")).cast("double").alias("padding"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        F.col("path").rlike("(?i)test|example|sample|mock|fixture|demo").cast("double").alias("path_sample"),
        F.pmod(F.xxhash64("path"), F.lit(64)).cast("double").alias("path_bucket"),
        F.col("before").rlike("[=:>]\\s*[\"'`]?$").cast("double").alias("assigned"), F.col("before").rlike("[\"'`]$").cast("double").alias("quoted"),
        F.lower(F.regexp_extract("before", "([A-Za-z]+)[^A-Za-z]*$", 1)).alias("prev"), F.lower(F.regexp_extract("after", "^[^A-Za-z]*([A-Za-z]+)", 1)).alias("next"))
    runs = found.select("cid", F.explode(F.regexp_extract_all(F.lower(v), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    known = runs.join(words.select("word", F.lit(1).alias("known")), "word", "left").groupBy("cid").agg(
        F.sum(F.when(F.col("known") == 1, F.char_length("word")).otherwise(0)).alias("in_words"))
    pairs = runs.select("cid", F.explode(_bigrams(F.col("word"))).alias("pair")).join(F.broadcast(letter_transitions(words)), "pair", "left")
    letters = pairs.groupBy("cid").agg(F.avg(F.coalesce("logp", F.lit(-10.0))).alias("letter_odds"))
    out = plain.join(known, "cid", "left").join(letters, "cid", "left")
    out = out.withColumns({"covered": F.coalesce(F.col("in_words") / F.col("length"), F.lit(0.0)), "letter_odds": F.coalesce("letter_odds", F.lit(-10.0))})
    for side in ("prev", "next"):
        own = odds.filter(F.col("side") == side).select(F.col("word").alias(side), F.col("odds").alias(f"{side}_odds"))
        out = out.join(own, side, "left").withColumns({
            f"{side}_odds": F.coalesce(f"{side}_odds", F.lit(0.0)), f"{side}_bucket": F.pmod(F.xxhash64(side), F.lit(32)).cast("double")})
    return out.dropDuplicates(["cid"])


def labelled(found: DataFrame, findings: DataFrame, id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """Candidates that labelled findings ``(id, value, label)`` name, at most ``rows`` of them in hash order.

    Several labels of a finding: the largest counts.  Null ids, values and labels name none.
    """
    own = findings.select(F.col(id_col).cast("long").alias("id"), F.col("value").alias("value"), F.col("label").cast("int").alias("label"))
    own = own.dropna().groupBy("id", "value").agg(F.max("label").alias("label"))
    return found.join(own, ["id", "value"]).orderBy(F.xxhash64("id", "value", "start"), "id", "start", "rid").limit(rows)


def neighbour_odds(train: DataFrame) -> DataFrame:
    """``(side, word, odds)`` of the words beside labelled findings, smoothed; at most two rows per labelled finding."""
    prev = F.lower(F.regexp_extract("before", "([A-Za-z]+)[^A-Za-z]*$", 1))
    next_ = F.lower(F.regexp_extract("after", "^[^A-Za-z]*([A-Za-z]+)", 1))
    both = train.select("label", F.explode(F.array(
        F.struct(F.lit("prev").alias("side"), prev.alias("word")), F.struct(F.lit("next").alias("side"), next_.alias("word")))).alias("w"))
    counts = both.groupBy("w.side", "w.word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    # words seen once say nothing: they would give the label away to the forest
    return counts.filter(F.col("a") + F.col("b") >= 3).select("side", "word", F.log((F.col("a") + 1) / (F.col("b") + 1)).alias("odds"))


def fit(train: DataFrame) -> RandomForestClassificationModel | float:
    """Forest of the labelled candidates with features; their share of secrets if they are all of one kind (0 if none)."""
    share = train.agg(F.avg("label")).first()[0]
    if share is None or share in (0, 1):
        return float(share or 0.0)
    data = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(train).select("v", F.col("label").cast("double").alias("label"))
    # one partition of at most TRAIN_ROWS rows in a fixed order: the forest is the same in every run
    data = stored(data.coalesce(1), "training")
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11).fit(data)


def scan(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per candidate: ``doc_id, start, length`` (code points), ``value_sha256, score, is_secret``.

    ``findings`` are labelled earlier findings (id, value, label 1 secret / 0 false).  Null and empty texts have no
    candidates; repeated rows give their candidates again; null ids are kept.  Without labels of both kinds the score
    is the share of label 1 (0 if there are none).
    """
    found = stored(candidates(docs, id_col, text_col, path_col), "found")
    words = stored(dictionary(docs, text_col), "dictionary")
    known = stored(labelled(found, findings, id_col, rows), "known")
    odds = stored(neighbour_odds(known), "odds")
    full = stored(features(found, words, odds), "features")
    train = full.join(known.select("rid", "start", "label"), ["rid", "start"]).orderBy(F.xxhash64("id", "value", "start"), "id", "start", "rid")
    model = fit(train)
    if isinstance(model, float):
        scored = full.withColumn("score", F.lit(model))
    else:
        data = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(full)
        scored = model.setProbabilityCol("p").transform(data).withColumn("score", vector_to_array("p")[1])
    return scored.select(F.col("id").alias("doc_id"), "start", F.char_length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                         "score", (F.col("score") >= THRESHOLD).alias("is_secret"))
