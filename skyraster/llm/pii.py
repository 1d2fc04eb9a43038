"""Personal data: pattern spans, and terms that give away what the patterns protect.

Base spans are leftmost non-overlapping matches of each kind (email, ip, card, phone) that
pass the kind's test. A term is a run of letters and digits of ``TERM_CHARS`` or more, in lower
case, not all digits, that no base span overlaps or touches. Terms and entities meet in whole texts: over the
corpus of N documents

    disclosure(term, entity) = log2(N * n(term, entity) / (n(term) * n(entity))) / log2(N / n(entity))

is the pointwise mutual information as a share of the entity's information content: 1 means
that the term never appears without that entity. A term that shares ``SUPPORT`` or more different
texts with an entity and discloses ``THRESHOLD`` or more of it is a span of kind ``term`` wherever
it stands, in every text, with or without a base span beside it. From ``REMOVE`` up the
sanitised text drops it, below that it generalises it to [TERM]; base spans become [KIND].

Everything is DataFrame functions; no Python sees a text. Positions are prefix sums over the pieces
between matches, worked out in blocks, so that n matches in one text take about n ** (4 / 3)
steps, and no step copies more than a block. Texts with base spans keep their terms once for each
different text. Of entities that the same texts hold, one stands for all, and a term is paired
with an entity only if its own count allows the threshold. Counts of terms are added up within each
task before the shuffle. Tables are broadcast only up to ``MAX_BROADCAST`` rows and
``MAX_BROADCAST_CHARS`` characters.

Patterns are written so that no text costs more than linear time: a local part or a digit run
is tried from its first character only, and repeats never give back what they took.

Cases: null and empty texts hold nothing (and stay null and empty); equal rows get equal spans; a table without base
spans has no terms; where spans of several kinds overlap, each character goes to the first kind in
the order of KINDS, and neighbouring characters of one kind share a mark; the control characters
that stand for kinds here (U+0002 to U+0005) are spaces in sanitised texts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, remove, shared_dir
from skyraster.llm.quality_rules import let

TERM_CHARS = 4
SUPPORT = 3
THRESHOLD = 0.8
REMOVE = 0.95
MAX_BROADCAST, MAX_BROADCAST_CHARS = 200_000, 32_000_000
KINDS = ("email", "ip", "card", "phone", "term")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FILL = dict(zip(KINDS, "\x02\x03\x04\x05", strict=False))  # stand for characters of base spans
_MASK = r"[^\x00\x01\x06-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # a term's characters, or those
_RUN = _MASK + f"{{{TERM_CHARS},}}+"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MANY = 256
_HITS = "array<struct<at:int,start:int,end:int,disclosure:double>>"
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def running(sizes: Column, depth: int = 2) -> Column:
    """Sums of what stands before each element of an int array, in nested blocks."""
    empty = F.expr("cast(array() as array<int>)")
    if depth == 0:
        zero = F.struct(F.lit(0).alias("sum"), empty.alias("out"))
        return F.aggregate(sizes, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"])

    def over(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(running(sums, 0), lambda before: F.flatten(F.transform(blocks, lambda b, i: F.transform(running(b, depth - 1), lambda x: x + F.get(before, i)))))

    def cut_up(all_: Column) -> Column:
        width = F.ceil(F.pow(F.size(all_).cast("double"), depth / (depth + 1))).cast("int")
        blocks = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / w).cast("int")), lambda k: F.slice(all_, k * w + 1, w)))
        return F.when(F.size(all_) == 0, empty).otherwise(let(blocks, over))

    return let(sizes, cut_up)


def find_all(text: Column, pattern: str | Column, kind: str) -> Column:
    """All matches with their places (code points), from the matches and the pieces between them."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.expr(f"cast(array() as {_SPANS})")

    def walk(found: Column) -> Column:
        def place(gaps: Column) -> Column:
            def spans(before: Column) -> Column:
                def one(v: Column, i: Column) -> Column:
                    return let(F.get(before, i) + F.length(F.get(gaps, i)), lambda start: F.struct(
                        F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value")))

                return F.transform(found, one)

            return let(running(F.transform(found, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))), spans)

        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), place))

    return let(F.regexp_extract_all(text, regex, F.lit(0)), walk)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: let(
        F.regexp_replace(p, "^0+", ""), lambda r: (F.length(r) < 3) | ((F.length(r) == 3) & (r <= "255"))))


def _luhn(value: Column) -> Column:
    def odd(d: Column) -> Column:
        def add(a: Column, k: Column) -> Column:
            digit = F.ascii(F.substr(d, F.length(d) - k, F.lit(1))) - 48
            twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
            return a + F.when(k % 2 == 1, twice).otherwise(digit)

        total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)
        return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(_digits(value), odd)


TESTS = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _passes(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda span: test(span["value"])


def _gate(text: Column, kind: str) -> Column:
    return text.contains(GATES[kind]) if kind == "email" else text.rlike(GATES[kind])


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) in the order of KINDS, then start."""
    parts = []
    for kind, pattern in PATTERNS.items():
        kept = F.filter(find_all(text, pattern, kind), _passes(TESTS[kind]))
        parts.append(F.when(_gate(text, kind), kept).otherwise(F.expr(f"cast(array() as {_SPANS})")))
    return F.concat(*parts)


def _bare(text: Column) -> Column:
    """The text without fillers of its own."""
    return F.when(text.rlike("[\x02-\x05]"), F.translate(text, "".join(_FILL.values()), "    ")).otherwise(text)


def masked(text: Column) -> Column:
    """The text with every character of a base span replaced by its kind's filler; as long as the text."""
    return let(_bare(text), _masked)


def _masked(text: Column) -> Column:

    def one(kind: str) -> Column:
        def fill(found: Column) -> Column:
            def put(gaps: Column) -> Column:
                pieces = F.transform(found, lambda v, i: F.concat(F.get(gaps, i), F.when(TESTS[kind](v), F.repeat(F.lit(_FILL[kind]), F.length(v))).otherwise(v)))
                return F.concat(F.array_join(pieces, ""), F.get(gaps, F.size(found)))

            return F.when(F.size(found) == 0, text).otherwise(let(F.split(text, PATTERNS[kind], -1), put))

        return F.when(_gate(text, kind), let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), fill)).otherwise(text)

    def over(a: Column, b: Column) -> Column:
        return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.between(_FILL["email"], _FILL["phone"]), x).otherwise(y)), "")

    changed = F.filter(F.array(*[one(k) for k in PATTERNS]), lambda m: m != text)
    return let(changed, lambda ms: F.when(F.size(ms) == 0, text).otherwise(F.aggregate(F.slice(ms, 2, 4), F.get(ms, F.lit(0)), over)))


def entity(span: Column) -> Column:
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _words(text: Column) -> Column:
    """The different runs of a text, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), _BREAK)), lambda w: F.length(w) >= TERM_CHARS)


def _free(run: Column) -> Column:
    """Whether a run of a masked text is a term: no base span in it, and not all digits."""
    return ~run.rlike("[\x02-\x05]") & run.rlike("[^0-9]")


def outside_terms(text: Column) -> Column:
    """The different terms of a whole text that no base span touches."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(masked(text)), F.lit(_RUN), F.lit(0))), _free)


def _node(name: str = "text") -> Column:
    return F.unhex(F.md5(_text(name)))


def measure(docs: DataFrame) -> DataFrame:
    """node (text hash), entities and terms of every row with base spans."""
    text = _text()
    gates = [_gate(text, k) for k in PATTERNS]
    some = docs.where(gates[0] | gates[1] | gates[2] | gates[3])
    out = some.select(_node().alias("node"), let(base_spans(text), lambda b: F.when(F.size(b) > 0, F.struct(
        F.array_distinct(F.transform(b, entity)).alias("entities"), outside_terms(text).alias("terms")))).alias("of"))
    return out.where("of is not null").select("node", "of.*")


def _few(table: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has few enough rows and characters."""
    rows, chars = table.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(table) if rows <= MAX_BROADCAST and (chars or 0) <= MAX_BROADCAST_CHARS else table


def _entities(texts: DataFrame) -> DataFrame:
    """(entity, n_entity): of entities in the same texts the least, with SUPPORT texts or more."""
    held = texts.select("node", "copies", F.explode("entities").alias("entity"))
    marks = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 31)) for k in range(2)]
    each = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count(F.lit(1)).alias("texts"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                      F.sum(marks[0]).alias("y"), F.sum(marks[1]).alias("z"))
    return each.where(F.col("texts") >= SUPPORT).groupBy("n_entity", "texts", "x", "y", "z").agg(F.min("entity").alias("entity")).select("entity", "n_entity")


def disclosing(docs: DataFrame, folder: str) -> DataFrame:
    """(term, disclosure) of the terms that reach the threshold for an entity, by the entity they disclose most of."""
    held = cut(measure(docs), f"{folder}/measured")
    texts = cut(held.groupBy("node", "entities", "terms").agg(F.count(F.lit(1)).alias("copies")), f"{folder}/texts")
    known = _few(cut(_entities(texts), f"{folder}/entities"))
    near = cut(texts.select("node", "copies", "terms", F.explode("entities").alias("entity")).join(known, "entity"), f"{folder}/near")
    wanted = near.select("node", "terms").dropDuplicates(["node"]).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    wanted = cut(wanted.where(F.col("texts") >= SUPPORT).select("term"), f"{folder}/terms")
    if wanted.isEmpty():
        return wanted.select("term", F.lit(0.0).alias("disclosure"))
    seen = docs.select(F.explode(_words(_text())).alias("term"))
    if wanted.count() <= MAX_BROADCAST:  # words meet the few terms before they are counted
        n_term = seen.join(_few(wanted), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    else:  # an inner join: a semi join would move below the sums and meet every word
        n_term = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(wanted, "term")
    n_term = _few(cut(n_term, f"{folder}/counts"))
    total = docs.count()
    n = {c: F.col(c).cast("double") for c in ("n_both", "n_term", "n_entity")}
    content = F.log(total / n["n_entity"])
    # n_both is n_entity at most; the threshold is met only up to this count of the term.
    allowed = n["n_term"] <= n["n_entity"] * F.pow(total / n["n_entity"], F.lit(1 - THRESHOLD + 1e-4)) + 1e-6
    pairs = near.select("copies", "entity", "n_entity", F.explode("terms").alias("term")).join(n_term, "term").where(allowed)
    joint = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    score = F.when(content > 0, F.log(total * n["n_both"] / (n["n_term"] * n["n_entity"])) / content).otherwise(0.0)
    scored = joint.select("term", F.round(score, 6).alias("disclosure")).where(F.col("disclosure") >= THRESHOLD)
    return scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def told(docs: DataFrame, terms: DataFrame, folder: str) -> DataFrame:
    """(t, said, placed) of each text (by its hash) with disclosing terms: these, or, of MANY or more, where they stand."""
    terms = _few(terms)
    rows = docs.select(_node().alias("node"), _text().alias("text"))
    said = rows.select("node", F.explode(_words(F.col("text"))).alias("term")).join(terms, "term").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("term", "disclosure"))).alias("said"))
    said = cut(said, f"{folder}/said")
    few = said.where(F.size("said") < MANY).select(F.col("node").alias("t"), "said", F.expr(f"cast(null as {_HITS}) as placed"))
    # Looking each run up in the text's own list would take the product of both.
    many = said.where(F.size("said") >= MANY).select("node")
    runs = rows.join(_few(many), "node", "left_semi").select("node", F.posexplode(find_all(masked(F.col("text")), _RUN, "term")).alias("at", "run"))
    runs = runs.where(_free(F.col("run.value"))).select("node", "at", "run.start", "run.end", F.lower("run.value").alias("term")).join(terms, "term")
    placed = runs.groupBy("node", "at", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    placed = placed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "start", "end", "disclosure"))).alias("placed"))
    return few.unionByName(placed.select(F.col("node").alias("t"), F.lit(None).cast("array<struct<term:string,disclosure:double>>").alias("said"), "placed"))


def _own(said: Column) -> Column:
    """Pattern of a text's own terms, which are letters and digits only, as whole runs of a masked text."""
    return F.concat(F.lit(f"(?<!{_MASK})(?iu:"), F.array_join(F.transform(said, lambda x: x["term"]), "|"), F.lit(f")(?!{_MASK})"))


def _told(said: Column, run: Column) -> Column:
    return let(F.lower(run), lambda v: F.get(F.filter(said, lambda x: x["term"] == v), F.lit(0))["disclosure"])


def _hits(hidden: Column) -> Column:
    """Run number (where it is known), start, end and disclosure of each disclosing term, in order, from columns said and placed."""
    none = F.expr(f"cast(array() as {_HITS})")

    def of(r: Column) -> Column:
        return F.struct(F.lit(None).cast("int").alias("at"), r["start"].alias("start"), r["end"].alias("end"), _told(F.col("said"), r["value"]).alias("disclosure"))

    looked = F.filter(F.transform(find_all(hidden, _own(F.col("said")), "term"), of), lambda h: h["disclosure"].isNotNull())
    return F.when(F.col("placed").isNotNull(), F.col("placed")).when(F.col("said").isNotNull(), looked).otherwise(none)


def sanitise(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Per document: doc_id, text, base (kind, start, end, value), hits (terms: at, start, end, disclosure) and clean_text."""
    docs = ensure(docs, doc_id="long", text="string")
    folder = folder or shared_dir(docs.sparkSession)
    terms = cut(disclosing(docs, f"{folder}/work"), f"{folder}/disclosing")
    remove(docs.sparkSession, f"{folder}/work")
    if terms.isEmpty():
        rows = docs.withColumns({"said": F.lit(None).cast("array<struct<term:string,disclosure:double>>"), "placed": F.expr(f"cast(null as {_HITS})")})
    else:
        found = cut(told(docs, terms, f"{folder}/work"), f"{folder}/told")
        remove(docs.sparkSession, f"{folder}/work")
        rows = docs.join(_few(found), _node() == F.col("t"), "left")
    # Steps of their own: one nested expression would be too deep for the analyser. Each is used more than once, so they stay apart.
    rows = rows.select("doc_id", "text", "said", "placed", base_spans(_text()).alias("base"))
    plain = F.size("base") == 0
    rows = rows.withColumn("hidden", F.when(plain & F.col("said").isNull() & F.col("placed").isNull(), F.lit("")).otherwise(masked(_text())))
    rows = rows.withColumn("hits", _hits(F.col("hidden")))
    clean = F.when(plain & (F.size("hits") == 0), _bare(_text())).otherwise(cleaned(F.col("hidden"), F.col("said"), F.col("placed")))
    return rows.select("doc_id", "text", "base", "hits", F.when(F.col("text").isNotNull(), clean).alias("clean_text"))


def _mark(disclosure: Column) -> Column:
    return F.when(disclosure >= REMOVE, "").when(disclosure < REMOVE, "[TERM]")


def cleaned(hidden: Column, said: Column, placed: Column) -> Column:
    """A masked text with its base spans named, and without its disclosing terms."""

    def by_number(pieces: Column) -> Column:
        def part(h: Column, k: Column) -> Column:
            since = F.coalesce(F.get(placed, k - 1)["at"] + 1, F.lit(0))  # pieces are gap, run, gap, run ...
            before = F.array_join(F.slice(pieces, 2 * since + 1, 2 * (h["at"] - since) + 1), "")
            return F.concat(before, _mark(h["disclosure"]))

        rest = F.array_join(F.slice(pieces, 2 * F.element_at(placed, -1)["at"] + 3, F.size(pieces)), "")
        return F.concat(F.array_join(F.transform(placed, part), ""), rest)

    def woven(gaps: Column) -> Column:
        runs = F.regexp_extract_all(hidden, F.lit(_RUN), F.lit(0))
        return let(let(runs, lambda r: F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(r), F.array(g, F.get(r, i))).otherwise(F.array(g))))), by_number)

    def by_name(found: Column) -> Column:
        def put(gaps: Column) -> Column:
            pieces = F.transform(found, lambda v, i: F.concat(F.get(gaps, i), F.coalesce(_mark(_told(said, v)), v)))
            return F.concat(F.array_join(pieces, ""), F.get(gaps, F.size(found)))

        return F.when(F.size(found) == 0, hidden).otherwise(let(F.split(hidden, _own(said), -1), put))

    out = F.when(F.size(placed) > 0, let(F.split(hidden, _RUN, -1), woven)).when(said.isNotNull(), let(F.regexp_extract_all(hidden, _own(said), F.lit(0)), by_name)).otherwise(hidden)
    for kind, fill in _FILL.items():
        out = F.regexp_replace(out, f"{fill}+", f"[{kind.upper()}]")
    return out


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts by kind, base_sha256, spans, clean_text."""
    found = sanitise(docs)
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    terms = F.transform("hits", lambda h: F.struct(F.lit("term").alias("kind"), h["start"].alias("start"), h["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *count, F.size("hits").cast("long").alias("n_term"), F.sha2(_join(F.col("base")), 256).alias("base_sha256"),
                        _join(F.concat(base, terms)).alias("spans"), "clean_text")


def _raw(kind: str, rank: int, pattern: str) -> str:
    return f"SELECT rid, '{kind}' AS kind, {rank} AS k, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d"


_PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_PLACE = "(coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0))::bigint"
_DIGIT = "substr(digits, (length(digits) - j)::bigint, 1)::int"
_FOLDED = "lower({})"

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text IS NULL AS missing, translate(coalesce(text, ''), chr(2) || chr(3) || chr(4) || chr(5), '    ') AS text FROM documents),
raw AS ({' UNION ALL '.join(_raw(kind, n, p) for n, (kind, p) in enumerate(zip(KINDS[:4], _PLAIN, strict=True)))}),
one AS (SELECT rid, kind, k, m, g, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
placed AS (SELECT rid, kind, k, m[i] AS value, {_PLACE} AS start, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits FROM one),
base AS (
  SELECT *, start + length(value) AS stop, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE {_FOLDED.format('value')} END AS entity FROM placed
  WHERE kind = 'email' OR (kind = 'phone' AND length(digits) BETWEEN 9 AND 15)
    OR (kind = 'ip' AND list_bool_and([length(ltrim(x, '0')) < 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255') FOR x IN string_split(value, '.')]))
    OR (kind = 'card' AND length(digits) BETWEEN 13 AND 19 AND
      list_sum([CASE WHEN j % 2 = 1 THEN 2 * {_DIGIT} - CASE WHEN {_DIGIT} > 4 THEN 9 ELSE 0 END ELSE {_DIGIT} END FOR j IN range(length(digits))]) % 10 = 0)),
words AS (SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT rid, regexp_extract_all(text, '{TERM}') AS m, string_split_regex(text, '{TERM}') AS g FROM d)),
seen AS (SELECT DISTINCT rid, {_FOLDED.format('m[i]')} AS term FROM words WHERE length(m[i]) >= {TERM_CHARS}),
run AS (
  SELECT rid, {_FOLDED.format('m[i]')} AS term, s, s + length(m[i]) AS e FROM (
    SELECT rid, m, i, (sum(length(g[i])) OVER w + sum(length(m[i])) OVER w - length(m[i]))::bigint AS s FROM words WINDOW w AS (PARTITION BY rid ORDER BY i))
  WHERE length(m[i]) >= {TERM_CHARS} AND regexp_matches(m[i], '[^0-9]')),
free AS (SELECT * FROM run r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.start <= r.e AND b.stop >= r.s)),
ent AS (SELECT entity, count(DISTINCT rid)::double AS n_entity FROM base GROUP BY 1),
joint AS (
  SELECT entity, term, count(*)::double AS n_both FROM (SELECT DISTINCT rid, entity FROM base) JOIN (SELECT DISTINCT rid, term FROM free) USING (rid) JOIN d USING (rid)
  GROUP BY 1, 2 HAVING count(DISTINCT text) >= {SUPPORT}),
counts AS (SELECT term, count(*)::double AS n_term FROM seen WHERE term IN (SELECT term FROM joint) GROUP BY 1),
told AS (
  SELECT term, max(score) AS score FROM (
    SELECT term, round(CASE WHEN ln(n_all / n_entity) > 0 THEN ln(n_all * n_both / (n_term * n_entity)) / ln(n_all / n_entity) ELSE 0 END, 6) AS score
    FROM joint JOIN counts USING (term) JOIN ent USING (entity), (SELECT count(*)::double AS n_all FROM d))
  WHERE score >= {THRESHOLD} GROUP BY 1),
hit AS (SELECT rid, s, e, score FROM free JOIN told USING (term)),
spans AS (SELECT rid, k, kind, start AS s, stop AS e FROM base UNION ALL SELECT rid, 9, 'term', s, e FROM hit),
joined AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
    count(*) FILTER (WHERE kind = 'phone') AS n_phone, count(*) FILTER (WHERE kind = 'term') AS n_term,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s, e) FILTER (WHERE kind <> 'term') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s, e) AS spans
  FROM spans GROUP BY rid),
covered AS (
  SELECT rid, p, min(k) AS k, min(upper(kind)) FILTER (WHERE k = least_k) AS kind FROM (
    SELECT rid, k, kind, p, min(k) OVER (PARTITION BY rid, p) AS least_k FROM (SELECT rid, k, kind, unnest(range(s, e)) AS p FROM spans WHERE kind <> 'term')) GROUP BY 1, 2),
marks AS (
  SELECT c.rid, c.p, CASE WHEN before.k IS NOT DISTINCT FROM c.k THEN '' ELSE '[' || c.kind || ']' END AS put
  FROM covered c LEFT JOIN covered before ON before.rid = c.rid AND before.p = c.p - 1
  UNION ALL
  SELECT rid, unnest(range(s, e)) AS p, CASE WHEN unnest(range(s, e)) = s AND score < {REMOVE} THEN '[TERM]' ELSE '' END FROM hit),
clean AS (
  SELECT t.rid, string_agg(coalesce(put, ch), '' ORDER BY t.p) AS clean_text FROM (
    SELECT rid, unnest(range(length(text))) AS p, unnest(string_split(text, '')) AS ch FROM d WHERE rid IN (SELECT rid FROM joined)) t
  LEFT JOIN marks ON marks.rid = t.rid AND marks.p = t.p GROUP BY t.rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_term, 0) AS n_term,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CASE WHEN NOT missing THEN coalesce(clean_text, text) END AS clean_text
FROM d LEFT JOIN joined USING (rid) LEFT JOIN clean USING (rid)
"""
