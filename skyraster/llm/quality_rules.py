"""Quality rules: base counts of a text and a hashed n-gram log-likelihood ratio.

Features of a text are its runs of one, two and three words, in their order, hashed into
``BUCKETS`` buckets for each length: a word's code is its CRC-32 modulo 2 ** 26, and a run's is
``STEP`` times that of the run without its last word, and that word's. Two multinomials over the
buckets, with add-``ALPHA`` smoothing, are estimated from all documents (raw) and from the trusted
ones (target); a text's score is the mean over its features of log(target / raw), with logs kept as
whole units of 1 / ``UNIT`` so that sums do not depend on order. Texts below a threshold are rejected, which comes from the
trusted texts' own scores: ``SPREAD`` times as far below their ``LOW`` quantile as that is below their median.

Trusted texts are those of a table that is passed in; without one, texts of strict form: ``TRUST_WORDS`` words or more, under 0.5 % symbols,
under 2 % pairs of capitals, no repeated line, and a fifth or more of the words distinct.

Everything is DataFrame functions. ``rate`` scans the texts once, for the base counts and the words'
codes, which are kept in a table from which buckets are counted (at most 3 * BUCKETS sums reach the
driver) and texts decided; ``keep`` scans them twice and leaves no table. No text is shuffled.

Cases: null and empty texts have no words, so the base fails them; a table without trusted
texts scores everything 0 and keeps what the base keeps; repeated rows are decided alike; very
long texts cost time n log n only if they repeat a window; extra columns are ignored by
``rate`` and kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, remove, shared_dir

BUCKETS = 1 << 14
CODES = 1 << 26  # so that what is added below stays within int
STEP = 5
ORDERS = 3
ALPHA = 1.0
UNIT = 10_000
LOW, SPREAD = 0.01, 3
TRUST_WORDS = 30
MIN_WORDS = 10
REPEAT_SHARE = 20
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body).getItem(0)


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _spaced(text: Column) -> Column:
    """The text with every white space a plain one, which splits without a pattern."""
    return F.regexp_replace(text, r"[\x09-\x0D]", " ")


def _words(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def _code(text: Column) -> Column:
    """A word's code: a non-negative int."""
    return (F.crc32(text.cast("binary")) % CODES).cast("int")


def _runs(a: Column, b: Column, c: Column, orders: int) -> list[Column]:
    """Buckets of the runs of one to ``orders`` words that begin at a; null past the end."""
    return [a % BUCKETS, (a * STEP + b) % BUCKETS + BUCKETS, (a * STEP % CODES * STEP + b * STEP + c) % BUCKETS + 2 * BUCKETS][:orders]


def _repeats(words: Column, codes: Column) -> Column:
    """Words inside windows of WINDOW words that the text holds twice or more."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), x + WINDOW) - x))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def again(rows: Column) -> Column:
        same = F.filter(rows, lambda r, i: F.coalesce(F.get(rows, i - 1)["h"] == r["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == r["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda r: r["i"])), covered)

    def starts(of: Column) -> Column:
        return F.slice(of, 1, F.greatest(F.size(of) - (WINDOW - 1), F.lit(0)))

    def look(hashes: Column) -> Column:
        return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), again)

    def by_words() -> Column:
        return let(F.transform(starts(words), lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)])), look)

    # Where no two windows have the same codes, no two are the same; else the words themselves are hashed. WINDOW is two pairs and one.
    def by_pairs(pairs: Column) -> Column:
        return let(F.transform(starts(codes), lambda c, i: F.xxhash64(F.get(pairs, i), F.get(pairs, i + 2), F.get(codes, i + 4))),
                   lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(by_words()))

    return let(F.transform(codes, lambda c, i: c * F.lit(CODES).cast("long") + F.get(codes, i + 1)), by_pairs)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(text.contains("\n"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(F.lit(0))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]"))


def trusted(text: Column, words: Column, codes: Column, symbols: Column, dup_lines: Column) -> Column:
    """Whether a text's form is strict enough for the target distribution."""
    chars = F.length(text)
    cheap = (F.size(codes) >= TRUST_WORDS) & (symbols * 200 <= chars) & (dup_lines == 0) & (F.regexp_count(text, F.lit("[A-Z][A-Z]")) * 50 <= chars)
    # As many different codes are as many different words; words are only told apart where codes do not do.
    varied = (F.size(F.array_distinct(codes)) * 5 >= F.size(codes)) | (F.size(F.array_distinct(words)) * 5 >= F.size(codes))
    return F.coalesce(cheap & varied, F.lit(False))


def analysis(text: Column) -> Column:
    """Struct of the base counts, whether the text is trusted, and its words' codes."""

    def counted(spaced: Column) -> Column:
        def of(w: Column, c: Column, form: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"), form["symbols"].cast("long").alias("n_symbols"),
                form["dup_lines"].cast("long").alias("n_dup_lines"), _repeats(w, c).cast("long").alias("n_repeat_words"), trusted(text, w, c, form["symbols"], form["dup_lines"]).alias("trusted"), c.alias("codes"))

        form = F.struct(_symbols(text).alias("symbols"), _dup_lines(text).alias("dup_lines"))
        return let(_words(spaced), lambda w: let(F.transform(w, _code), lambda c: let(form, lambda f: of(w, c, f))))

    return let(_spaced(text), counted)


def coded_features(coded: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bt: one row for each feature of a table with trusted, codes and, if there is a target from outside, outside; those of trusted texts in buckets of their own, and those of a target from outside."""
    following = [F.slice("codes", k, F.size("codes")).alias(n) for k, n in enumerate("abc", 1)]
    outside = F.col("outside") if "outside" in coded.columns else F.lit(False)
    base = F.when(outside, 2 * orders * BUCKETS).when(F.col("trusted"), orders * BUCKETS).otherwise(0).alias("base")
    rows = coded.where(F.size("codes") > 0).select(base, F.inline(F.arrays_zip(*following)).alias(*"abc"))
    each = F.array(*_runs(F.col("a"), F.col("b"), F.col("c"), orders))
    return rows.select("base", F.explode(each).alias("b")).where("b is not null").select((F.col("base") + F.col("b")).alias("bt"))


def log_ratios(features: DataFrame, orders: int = ORDERS) -> list[int]:
    """log(target / raw) of every bucket in units."""
    space = orders * BUCKETS
    seen = features.groupBy("bt").agg(F.count(F.lit(1)).alias("n"))
    target = F.when(F.col("bt") >= space, F.col("n")).otherwise(0)
    raw = F.when(F.col("bt") < 2 * space, F.col("n")).otherwise(0)
    counts = seen.groupBy((F.col("bt") % space).alias("b")).agg(F.sum(raw).alias("raw"), F.sum(target).alias("target"))
    found = counts.collect()  # at most ORDERS * BUCKETS sums
    all_raw, all_target = sum(r.raw for r in found), sum(r.target for r in found)
    out = [0] * space
    for r in found if all_target else []:
        ratio = math.log((r.target + ALPHA) / (all_target + ALPHA * space)) - math.log((r.raw + ALPHA) / (all_raw + ALPHA * space))
        out[r.b] = round(ratio * UNIT)
    return out


def units(codes: Column, ratios: list[int], orders: int = ORDERS) -> Column:
    """Sum of the log ratios of a text's features."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")

    def at(c: Column, i: Column) -> Column:
        found = [F.get(table, x) for x in _runs(c, F.get(codes, i + 1), F.get(codes, i + 2), orders)]
        return sum((F.coalesce(x, F.lit(0)) for x in found[1:]), found[0])

    return F.aggregate(F.transform(codes, at), F.lit(0).cast("long"), lambda x, y: x + y)


def form(text: Column) -> Column:
    """Struct of a text's codes and whether it is trusted: what ``log_ratios`` and ``units`` need."""
    known = F.struct(_symbols(text).alias("symbols"), _dup_lines(text).alias("dup_lines"))
    return let(_words(_spaced(text)), lambda w: let(F.transform(w, _code), lambda c: let(known, lambda f: F.struct(
        c.alias("codes"), trusted(text, w, c, f["symbols"], f["dup_lines"]).alias("trusted")))))


def _failed(of: Callable[[str], Column]) -> Column:
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > REPEAT_SHARE * of("n_words"))


def _features(of: Callable[[str], Column]) -> Column:
    return sum((F.greatest(of("n_words") - k, F.lit(0)) for k in range(1, ORDERS)), of("n_words"))


def _kept(of: Column, threshold: int) -> Column:
    """Whether a text stays, from one struct that is looked at once."""
    return let(of, lambda x: ~_failed(lambda c: x[c]) & (x["units"] >= _features(lambda c: x[c]) * threshold))


def _score(units_: Column, features: Column) -> Column:
    return F.when(features > 0, F.floor(units_ / features)).otherwise(0).cast("long")


def _with(coded: DataFrame, target: DataFrame | None) -> DataFrame:
    """trusted, outside and codes of coded rows, and of the texts of a target if there is one; then no other text is trusted."""
    rows = coded.select(F.col("trusted") if target is None else F.lit(False).alias("trusted"), F.lit(False).alias("outside"), "codes")
    if target is None:
        return rows
    return rows.unionByName(ensure(target, text="string").select(form(_text()).alias("of")).select(F.lit(True).alias("trusted"), F.lit(True).alias("outside"), "of.codes"))


def _threshold(coded: DataFrame, ratios: list[int], threshold: float | None) -> int:
    """Units a feature below which a text goes."""
    if threshold is not None:
        return int(threshold * UNIT)
    n = F.size("codes")
    features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, ORDERS)), n)
    scores = coded.where(F.col("trusted") & (n > 0)).select(_score(units(F.col("codes"), ratios), features).alias("s"))
    found = scores.agg(*[F.expr(f"percentile_disc({q}) within group (order by s)").alias(c) for q, c in ((LOW, "low"), (0.5, "middle"))]).first()
    return 0 if found.low is None else int(found.low - SPREAD * (found.middle - found.low))


def _rated(coded: DataFrame, ratios: list[int], threshold: int) -> DataFrame:
    """Adds units, n_features, base_failed and kept to a table of coded rows."""
    out = coded.withColumn("units", units(F.col("codes"), ratios)).withColumn("n_features", _features(F.col))
    out = out.withColumn("base_failed", _failed(F.col))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("units") >= F.col("n_features") * threshold))


def rate(docs: DataFrame, target: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """Per document: doc_id, n_words, base counts, base_failed, kept, and score (units a feature).

    target: trusted texts (text), where there are any; threshold: a mean log ratio, in place of that of the target's scores.
    """
    docs = ensure(docs, doc_id="long", text="string")
    coded = cut(docs.select("doc_id", analysis(_text()).alias("of")).select("doc_id", "of.*"), f"{shared_dir(docs.sparkSession)}/coded")
    both = _with(coded, target)
    ratios = log_ratios(coded_features(both))
    rated = _rated(coded, ratios, _threshold(both, ratios, threshold))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", _score(F.col("units"), F.col("n_features")).alias("score"))


def keep(docs: DataFrame, target: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged."""
    # Whole rows are not written to a table for this: their codes are, for the counts, and are worked out again.
    work = shared_dir(docs.sparkSession)
    both = _with(cut(docs.select(form(_text()).alias("of")).select("of.*"), f"{work}/codes"), target)
    ratios = log_ratios(coded_features(both))
    least = _threshold(both, ratios, threshold)
    remove(docs.sparkSession, work)
    coded = docs.select(F.struct("*").alias("_row"), let(let(analysis(_text()), lambda a: F.struct(a["n_words"].alias("n_words"), a["n_repeat_words"].alias("n_repeat_words"), units(a["codes"], ratios).alias("units"))), lambda x: x).alias("of"))
    return coded.where(_kept(F.col("of"), least)).select("_row.*")


_BASE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY rid),
base AS (
  SELECT w.*, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(regexp_extract_all(text, '[#*$%&|<>]')) * 200 <= length(text) AND len(regexp_extract_all(text, '[A-Z][A-Z]')) * 50 <= length(text)
      AND len(w.w) >= 30 AND len(list_distinct(w.w)) * 5 >= len(w.w) AND len(lines) = len(list_distinct(lines)) AS trusted
  FROM w LEFT JOIN rep USING (rid)),
crc_table AS (
  SELECT list(c ORDER BY k) AS tab FROM (
    SELECT k, list_reduce(list_prepend(k::ubigint, range(8)::ubigint[]),
      lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::ubigint) ELSE a >> 1 END) AS c FROM range(256) t(k))),
tok AS (SELECT DISTINCT unnest(w) AS tok FROM w),
crc AS (
  SELECT tok, xor(list_reduce(list_prepend(4294967295::ubigint, [('0x' || substr(hex(tok), 2 * i + 1, 2))::ubigint FOR i IN range(strlen(tok))]),
    lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::bigint])), 4294967295::ubigint)::bigint % 67108864 AS c FROM tok, crc_table),
pos AS (SELECT rid, trusted, unnest(w) AS tok, unnest(range(1, len(w) + 1)) AS i FROM base),
coded AS (SELECT rid, trusted, c, lead(c) OVER o AS c2, lead(c, 2) OVER o AS c3 FROM pos JOIN crc USING (tok) WINDOW o AS (PARTITION BY rid ORDER BY i)),
"""

_SCORE_SQL = """
cnt AS (SELECT b, count(*)::double AS raw, sum(trusted::int)::double AS target FROM feat GROUP BY b),
tot AS (SELECT sum(raw) AS all_raw, sum(target) AS all_target FROM cnt),
lw AS (
  SELECT b, CASE WHEN all_target > 0 THEN round_even((ln((target + 1) / (all_target + {space})) - ln((raw + 1) / (all_raw + {space}))) * 10000, 0)::bigint ELSE 0 END AS u
  FROM cnt, tot),
sc AS (SELECT rid, any_value(trusted) AS trusted, sum(u) AS units, count(*) AS n FROM feat JOIN lw USING (b) GROUP BY rid),
qu AS (SELECT quantile_disc(floor(units / n::double)::bigint, {low}::double) AS low, quantile_disc(floor(units / n::double)::bigint, 0.5::double) AS middle FROM sc WHERE trusted),
th AS (SELECT coalesce(low - {spread} * (middle - low), 0) AS least FROM qu)
"""


def scores_sql(orders: int = ORDERS) -> str:
    """CTEs up to ``base`` (rid, doc_id, text and counts of every document) and ``sc`` (rid, units, n)."""
    runs = [("c", "true"), ("5 * c + c2", "c2 IS NOT NULL"), ("25 * c + 5 * c2 + c3", "c3 IS NOT NULL")][:orders]
    feat = " UNION ALL ".join(f"SELECT rid, trusted, {k * BUCKETS} + ({x}) % {BUCKETS} AS b FROM coded WHERE {there}" for k, (x, there) in enumerate(runs))
    return f"{_BASE_SQL} feat AS ({feat}), {_SCORE_SQL.format(space=orders * BUCKETS, low=LOW, spread=SPREAD)}"


ORACLE = scores_sql() + r"""
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
  n_repeat_words::bigint AS n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(units, 0) >= coalesce(n, 0) * (SELECT least FROM th) AS kept,
  coalesce(floor(units / n::double), 0)::bigint AS score
FROM base LEFT JOIN sc USING (rid)
"""
