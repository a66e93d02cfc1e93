"""Secret scanning: candidate strings judged by a random forest trained on labelled findings."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import stored, words

#: A candidate is a run of at least so many characters of this kind.
LEAST = 16
RUN = f"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: A part of a finding is a word if it stands in the corpus so often as a word of its own.
COMMON = 5
WHOLE_WORD = r"(?<![^\s(\"'])\p{L}{3,}(?=[\s.,;:!?)\"']|$)"
#: Parts of up to so many kinds are broadcast to be counted.
BROADCAST_ROWS = 200_000
#: Labelled findings of each kind the forest is trained on.
LABELLED = 4_000
NAMES = "secret|token|passw|passwd|pwd|api|key|auth|credential|private"
#: A secret-like name; it, an = or :, and the value given to it, which is a candidate from so many characters on.
VALUE_LEAST = 6
#: The name is looked for once in each run of letters, so a long run costs no more than its length.
NAMED = f"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?i:{NAMES}))[A-Za-z0-9_-]*+[\\\\\"'`\\])]{{0,4}} ?"
SIGN = "[=:]{1,2}>? ?"
#: In quotes (group 2), in quotes that the word does not close (4), or bare up to a closing sign or the next name (5).
ASSIGNED = (
    f"(?s){NAMED}{SIGN}(?:"
    r"\\?([\"'`])(.+?)\\?\1(?![A-Za-z0-9])"
    r"|\\?([\"'`])(\S+)$"
    r"|(?![{\[(]*\\?[\"'`])(\S+?)(?=[\"'`\\]*[&;,][A-Za-z_][A-Za-z0-9_.-]*+[\"'`]?[=:]|\\?[\"'`][>)\]}]|\s|$))"
)
#: What a value may follow that stands at the start of its word: a name with a sign, or a name alone before a sign.
LEAD_IN = f"{NAMED}(?:{SIGN})?$"
PLAIN = r"^[A-Za-z]{1,12}[.,]?$"
TRIAL_PATHS = "test|example|sample|mock|fixture|demo|docs?/"
#: Neighbouring kinds of characters, counted in a candidate.
STEPS = {
    "lower_digit": "[a-z](?=[0-9])", "digit_lower": "[0-9](?=[a-z])", "upper_digit": "[A-Z](?=[0-9])",
    "digit_upper": "[0-9](?=[A-Z])", "lower_upper": "[a-z](?=[A-Z])", "upper_lower": "[A-Z](?=[a-z])",
    "digit_digit": "[0-9](?=[0-9])", "vowel_other": "[AEIOUaeiou](?=[^AEIOUaeiou])", "twice": r"(.)(?=\1)",
}
FEATURES = [
    "length", "digits", "uppers", "kinds", "hex", "coverage", "longest_letters", *STEPS,
    "named", "assigned", "quoted", "next_plain", "trial_path", "path_depth",
]


def parts(finding: Column) -> Column:
    """The letter runs of a finding that may be words, in lower case; a capital begins a new one (`apiKeyOf`, `HTTPServer`)."""
    runs = F.regexp_extract_all(finding, F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"), 0)
    return F.transform(runs, F.lower)


def word_table(docs: DataFrame, asked: DataFrame, text_column: str = "text", least: int = COMMON) -> DataFrame:
    """(part): those of the distinct `asked` parts that stand in the texts as a word of their own at least `least` times.

    Only asked words are counted, over all rows; the list of them is broadcast where it is short.
    """
    known = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    each = docs.select(F.explode(F.regexp_extract_all(F.lower(text_column), F.lit(WHOLE_WORD), 0)).alias("part"))
    return each.join(known, "part", "left_semi").groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("part")


def with_coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds `covered`: how many letters of the finding are in parts that `known` has."""
    each = found.select("finding").distinct().select("finding", F.explode(parts(F.col("finding"))).alias("part"))
    counted = each.join(known, "part").groupBy("finding").agg(F.sum(F.length("part")).alias("covered"))
    counted = counted.withColumnRenamed("finding", "finding_")
    met = found.join(counted, F.col("finding") == F.col("finding_"), "left").drop("finding_")
    return met.withColumn("covered", F.coalesce("covered", F.lit(0)))


def assigned_values(lead_in: Column, text: Column, rest: Column) -> Column:
    """The values given to secret-like names in a word; `rest` closes one whose quotes go on in later words."""

    def values(c: Column) -> Column:
        each = lambda group: F.regexp_extract_all(c, F.lit(ASSIGNED), group)
        some = lambda group: F.filter(each(F.lit(group)), lambda v: v != "")
        # closing signs are no part of a bare value; brackets are where it opens one itself
        ends = lambda v: F.regexp_replace(v, F.when(v.rlike(r"[(\[{<]"), "[,;.\"'`\\\\]+$").otherwise("[,;.)\\]}>\"'`\\\\]+$"), F.lit(""))
        return F.concat(
            some(2),
            F.transform(some(4), lambda v: F.when(rest.isNull(), ends(v)).otherwise(F.concat_ws(" ", v, rest))),
            F.transform(some(5), ends),
        )

    inside = F.when(text.rlike("[=:]"), values(text)).otherwise(F.array().cast("array<string>"))
    both = F.when(lead_in == "", inside).otherwise(F.concat(values(F.concat(lead_in, text)), inside))
    return F.array_distinct(F.filter(both, lambda v: F.length(v) >= VALUE_LEAST))


def candidates(docs: DataFrame, id_column: str, text_column: str, path_column: str | None) -> DataFrame:
    """(id, path, word, finding, lead, before, after, follow): candidates, where they stand and between what.

    They are the runs of at least LEAST characters, and the whole values given to secret-like names (`password=...`,
    `"api_key": "..."`), of VALUE_LEAST characters or more and whatever signs; a value that is such a run counts once.
    """
    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    read = docs.select(F.col(id_column).alias("id"), path.alias("path"), words(F.col(text_column)).alias("ws"))
    word = lambda i: F.get(F.col("ws"), i)
    # the words with a quote, so that a value's closing one is found without joining all that follows
    having = lambda q: F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda j: F.contains(word(j), F.lit(q)))
    read = read.where(F.size("ws") > 0).select("*", having('"').alias("double"), having("'").alias("single"), having("`").alias("back"))
    signed = lambda i: word(i).rlike("[=:]") | F.coalesce(word(i - 1).rlike("[=:]>?$"), F.lit(False))
    places = F.filter(
        F.sequence(F.lit(0), F.size("ws") - 1), lambda i: (F.octet_length(word(i)) >= LEAST) | signed(i)
    )

    def rest(i: Column) -> Column:
        """The later words up to the quote that closes one opened in this word; null where there is none."""
        quote = F.regexp_extract(word(i), "(?:^|[=:]>?)[{\\[(\\\\]*([\"'`])[^\"'`]*$", 1)
        near = F.concat_ws(" ", word(i - 2), word(i - 1), word(i)).rlike(f"(?i:{NAMES})")
        closing = F.when(quote == '"', F.col("double")).when(quote == "'", F.col("single")).otherwise(F.col("back"))
        closes = F.get(F.filter(closing, lambda j: j > i), 0)
        later = F.concat_ws(" ", F.slice("ws", i + 2, closes - i))
        return F.when(signed(i) & near & (quote != ""), F.when(closes.isNotNull(), F.get(F.split(later, quote, 2), 0)))

    found = F.transform(
        places,
        lambda i: F.struct(
            i.alias("word"), word(i).alias("text"), F.concat_ws(" ", word(i - 2), word(i - 1)).alias("before"),
            word(i + 1).alias("after"), rest(i).alias("rest"),
        ),
    )
    each = read.select("id", "path", F.explode(found).alias("f")).select("id", "path", "f.*")
    each = each.withColumn("lead_in", F.regexp_extract(F.concat("before", F.lit(" ")), LEAD_IN, 0))
    runs = F.regexp_extract_all("text", F.lit(RUN), 0)
    values = assigned_values(F.col("lead_in"), F.col("text"), F.col("rest"))
    told = each.select(
        "*", F.transform(runs, lambda v: F.struct(v.alias("finding"), F.lit(False).alias("value"))).alias("runs"),
        F.transform(F.array_except(values, runs), lambda v: F.struct(v.alias("finding"), F.lit(True).alias("value"))).alias("values"),
    )
    one = told.select("*", F.explode(F.concat("runs", "values")).alias("c")).select("*", "c.*").drop("c", "runs", "values")
    over = F.col("value") & F.col("rest").isNotNull() & ~F.contains("text", "finding")
    first = F.when(over, F.substring_index("finding", " ", 1)).otherwise(F.col("finding"))
    # a value stands behind the first sign of its word, unless the sign is in a word before
    skip = F.when(F.col("value") & ~F.col("lead_in").rlike("[=:]"), F.length(F.regexp_extract("text", "^[^=:]*", 0))).otherwise(0)
    placed = one.withColumn("first", first).withColumn("skip", skip).withColumn("at", F.expr("locate(first, text, skip + 1)"))
    return placed.select(
        "id", "path", "word", "finding", F.expr("substr(text, 1, at - 1)").alias("lead"), "before",
        F.when(~over, F.col("after")).alias("after"),
        F.when(over, F.lit('"')).otherwise(F.expr("substr(text, at + length(first), 1)")).alias("follow"),
    )


def with_features(found: DataFrame, known: DataFrame) -> DataFrame:
    """The FEATURES of each candidate: its length and characters, their transitions, dictionary, path and neighbours."""
    columns, found = found.columns, with_coverage(found, known)
    v, n = F.col("finding"), F.length("finding").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    near = F.lower(F.concat_ws(" ", "before", "lead"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    letters = F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), 0), lambda x: F.length(x))
    values: dict[str, Column] = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "kinds": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": flag(v.rlike("^[0-9a-f]+$")),
        "coverage": F.col("covered") / n,
        "longest_letters": F.coalesce(F.array_max(letters), F.lit(0)) / n,
        **{name: share(pattern) for name, pattern in STEPS.items()},
        "named": flag(near.rlike(NAMES)),
        "assigned": flag(F.concat_ws("", "before", "lead").rlike("[=:]>?[\"'` ]*$")),
        "quoted": flag(F.col("follow").isin('"', "'")),
        "next_plain": flag(F.col("after").rlike(PLAIN)),
        "trial_path": flag(F.lower("path").rlike(TRIAL_PATHS)),
        "path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
    }
    return found.select(*columns, *[values[name].cast("double").alias(name) for name in FEATURES])


def rule_labels(found: DataFrame) -> DataFrame:
    """Adds `label`: 1 for strings that are secrets by their form and place, 0 for those that cannot be, else null.

    Secrets are access key ids of a fixed form and random strings given to a name like `token` or `password`. A number,
    and letters without a digit that no such name precedes, are none; nor is a plain word in running text after such a
    name (`key: winter came`). The forest sees neither these rules nor the text.
    """
    v = F.col("finding")
    named = F.lower(F.concat_ws(" ", "before", "lead")).rlike(f"({NAMES})[a-z_]*[\"' ]*[=:]")
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return found.withColumn(
        "label",
        F.when(v.rlike("^AKIA[0-9A-Z]{16}$") & v.rlike("[0-9]"), 1.0)
        .when(named & mixed, 1.0)
        .when(v.rlike("^[0-9]+$") & ~named, 0.0)
        .when(v.rlike("^[A-Za-z]+$") & ~named, 0.0)
        .when(v.rlike("^[A-Za-z][a-z]+$") & (F.length(v) < LEAST) & F.col("after").rlike(PLAIN), 0.0),
    )


def sample(labelled: DataFrame, most: int = LABELLED) -> DataFrame:
    """At most about `most` labelled rows of each kind, chosen by a hash of the row: the same on every run."""
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    roll = F.pmod(F.xxhash64("finding", "before", "lead", "id", "word"), F.lit(1_000_000)) / 1_000_000.0
    part = F.lit(0.0)
    for label, n in counts.items():
        part = F.when(F.col("label") == label, F.lit(min(1.0, most / n))).otherwise(part)
    return labelled.where(roll < part)


def train(labelled: DataFrame, trees: int = 24, depth: int = 6) -> Transformer | float:
    """A forest on the FEATURES of labelled rows (`label` 0.0 or 1.0); a constant where there are not both kinds."""
    kinds = {r.label for r in labelled.select("label").distinct().collect()}
    if len(kinds) < 2:
        return kinds.pop() if kinds else 1.0  # unjudged findings are reported
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt"
    )
    return forest.fit(vectors.select("features", "label"))


def judge(found: DataFrame, model: Transformer | float) -> DataFrame:
    if not isinstance(model, Transformer):
        return found.withColumn("score", F.lit(float(model)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    judged = model.transform(vectors)
    return judged.withColumn("score", vector_to_array("probability")[1])


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str | None = "source",
    labelled: DataFrame | None = None,
    most_labelled: int = LABELLED,
    least_score: float = 0.5,
) -> DataFrame:
    """(id, word, finding, score, is_secret): every candidate string with the forest's verdict on it.

    `word` is the index of the white-space separated word the string stands in. `labelled` holds labelled findings, in
    the columns of `candidates` and `label`; without it `rule_labels` labels those of `docs`. About `most_labelled`
    rows of each kind, picked by hash, train the forest; all candidates of all whole texts are judged. A text that is
    null or empty has none, an empty table none at all; texts may be of any length, a text is held in memory as a whole; null ids and paths are allowed, rows repeated are reported each.
    Where the labels are all of one kind that kind is the verdict; without any, all candidates are reported as secrets.
    """
    raw = stored(candidates(docs, id_column, text_column, path_column), "findings")
    findings = raw.select("finding") if labelled is None else raw.select("finding").unionByName(labelled.select("finding"))
    asked = stored(findings.select(F.explode(parts(F.col("finding"))).alias("part")).distinct(), "parts")
    known = stored(word_table(docs, asked, text_column), "words")
    found = stored(with_features(raw, known), "candidates")
    given = rule_labels(found) if labelled is None else with_features(labelled, known)
    chosen = stored(sample(given.where("label is not null"), most_labelled).coalesce(1), "labelled")
    judged = judge(found, train(chosen.orderBy("finding", "before", "lead", "id", "word").coalesce(1)))
    return judged.select(
        F.col("id").alias(id_column), F.col("word").cast("long").alias("word"), "finding", "score",
        (F.col("score") >= least_score).alias("is_secret"),
    )
