"""Quality rules with verdicts on hosts.

Every document is tested by simple rules. Failures are added up per host, each host's rate is shrunk towards
the others by a beta prior that is fitted to the hosts themselves, and hosts whose shrunk rate is too high take
their remaining documents with them. DataFrame and SQL functions only.

The prior's two parameters come from the mean of the host rates and the mean of the unbiased squares
``k (k - 1) / (n (n - 1))`` over hosts with two documents or more. Where hosts differ no more than chance
would have it, all share the pooled rate. Rates are summed as whole billionths, so that the order of summing
cannot change a result.

Null texts have no words and fail. A null host is a host of its own. Repeated rows count as often as they
occur. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common
from cohortloom.session import cut_lineage

#: Between words, in a regular expression and as characters.
SEPARATORS = " \\\\t-\\\\r"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MAX_HOST_RATE = 0.5


def text_measures(docs: DataFrame, text: Column, **kept: Column) -> DataFrame:
    """Kept columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each text.

    All within the row. Repeated runs of three words are first looked for by hashes; only texts in which two
    hashes agree are sorted by the words themselves, so the count is exact.
    """
    named = docs.select(*[c.alias(n) for n, c in kept.items()], F.coalesce(text, F.lit("")).alias("_t"))
    counts = common.let("w", common.words_sql("_t", SEPARATORS), common.let(
        "h", "transform(w, x -> xxhash64(x))", common.let(
            "g", common.window_hashes("h", 3), common.let("r", repeat_words("w", "g"), (
                f"struct(cast(size(w) AS bigint) AS n_words, r AS n_repeat_words, size(w) < {MIN_WORDS} OR "
                f"100 * r > {MAX_REPEATED_PERCENT} * size(w) AS base_failed)")))))
    lines = common.let(
        "l", f"filter(split(_t, '\\\\n', -1), x -> x rlike '[^{SEPARATORS}]')", "size(l) - size(array_distinct(l))")
    return named.select(
        *kept, F.expr(counts).alias("_m"),
        F.char_length(F.translate("_t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.expr(lines).cast("bigint").alias("n_dup_lines"),
    ).select(*kept, "_m.n_words", "word_chars", "n_symbols", "n_dup_lines", "_m.n_repeat_words", "_m.base_failed")


def repeat_words(words: str, hashes: str) -> str:
    """SQL: words inside runs of three words that occur twice or more. ``hashes`` has one entry per run."""
    runs = (f"sort_array(transform(sequence(0, size({hashes}) - 1), i -> "
            f"struct({words}[i] AS a, {words}[i + 1] AS b, {words}[i + 2] AS c, i AS i)))")

    def same(x: str, y: str) -> str:
        return f"(s[{x}].a = s[{y}].a AND s[{x}].b = s[{y}].b AND s[{x}].c = s[{y}].c)"

    twice = common.let("s", runs, (
        "filter(transform(sequence(0, size(s) - 1), j -> "
        f"IF((j > 0 AND {same('j', 'greatest(j - 1, 0)')}) OR "
        f"(j < size(s) - 1 AND {same('j', 'least(j + 1, size(s) - 1)')}), s[j].i, NULL)), x -> x IS NOT NULL)"))
    # each run covers three words, less what the next one covers too
    covered = common.let("p", f"sort_array({twice})", (
        "aggregate(sequence(0, greatest(size(p) - 1, 0)), 0L, (n, j) -> n + CASE WHEN size(p) = 0 THEN 0 "
        "WHEN j = size(p) - 1 THEN 3 ELSE least(3, p[j + 1] - p[j]) END)"))
    return f"CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE {covered} END"


def host_name(host: str) -> Column:
    """Key of a host; null is a host too."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def host_verdicts(tested: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, host_docs, host_failures, host_rate, host_kept) from rows of (host, base_failed)."""
    hosts = tested.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("host_failures"))
    hosts = cut_lineage(hosts)
    n, k = F.col("host_docs").cast("double"), F.col("host_failures").cast("double")
    billion = F.lit(1e9)
    moments = hosts.agg(
        F.sum("host_failures").alias("k"), F.sum("host_docs").alias("n"),
        F.sum(F.when(F.col("host_docs") > 1, F.round(k / n * billion).cast("bigint"))).alias("m1"),
        F.sum(F.when(F.col("host_docs") > 1, F.round(
            k / n * ((k - 1) / (n - 1)) * billion).cast("bigint"))).alias("m2"),
        F.sum((F.col("host_docs") > 1).cast("bigint")).alias("hosts")).first()
    if moments["n"] is None:
        prior = (0.0, 0.0)
        pooled = 0.0
    else:
        prior, pooled = beta_prior(moments["m1"], moments["m2"], moments["hosts"]), moments["k"] / moments["n"]
    if prior is None:
        rate = F.lit(pooled)
    else:
        rate = (k + prior[0]) / (n + prior[0] + prior[1])
    return hosts.withColumn("host_rate", F.round(rate, 6)).withColumn("host_kept", F.col("host_rate") < max_rate)


def beta_prior(m1: int | None, m2: int | None, hosts: int) -> tuple[float, float] | None:
    """Prior from sums of rates and squared rates in billionths; None if hosts differ by chance only."""
    if not hosts:
        return None
    mean, square = m1 / 1e9 / hosts, m2 / 1e9 / hosts
    spread = square - mean * mean
    if spread <= 0 or mean - square <= 0:
        return None
    strength = (mean - square) / spread
    return mean * strength, (1 - mean) * strength


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures of every document, the base rule, its host's figures and whether it is kept."""
    tested = text_measures(docs, F.col(text_column), id=F.col(id_column), host=host_name(host_column))
    tested = cut_lineage(tested)
    verdicts = host_verdicts(tested, max_rate)
    joined = common.join_groups(tested, verdicts, "host", "host_docs", F.col("id"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host")


def kept_documents(docs: DataFrame, text_column: str = "text", host_column: str = "source",
                   max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass the base rule and whose host is not rejected, all columns as they came."""
    tested = text_measures(docs, F.col(text_column), host=host_name(host_column)).select("host", "base_failed")
    rejected = host_verdicts(tested, max_rate).where(~F.col("host_kept")).select(F.col("host").alias(HOST))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # measured again instead of written with the texts: the counts cost less than a copy of the table
    passed = text_measures(docs.select(row, F.col(text_column).alias("_in"), host_name(host_column).alias(HOST)),
                           F.col("_in"), _row=F.col("_row"), **{HOST: F.col(HOST)}).where("NOT base_failed")
    return common.semi_join(passed, rejected, HOST, "left_anti").select("_row.*")


HOST = "_cohortloom_host"
