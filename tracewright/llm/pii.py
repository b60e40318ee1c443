"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame operations only.

Base entities (e-mail, IPv4, payment card, phone) are the seeds. The words around a mention induce lexical patterns
of four shapes: the word before, the two words before, the word after, and both neighbours. Candidates are all other
runs of one broad form (number groups, things joined by an at sign or a spelled-out one, groups with colons), whatever
their kind. Patterns and instances form a graph in which scores go back and forth for some rounds. For each kind

- a pattern is worth the sum of its instances' scores over their number, drawn down by ``doubt`` where they are few,
  and nothing unless ``seeds`` of its instances are accepted;
- a candidate is worth the mean of its patterns of one shape, at the shape where that is most; a context that no accepted
  seeds tell anything of weighs a tenth. Its form rules kinds out: an at sign means e-mail, a colon an address, numbers neither;
- a candidate at ``least`` or above is accepted and is a seed in the next round.

Mentions of accepted candidates become spans of the kind where they score most. Base spans always stay; a new span
never overlaps one, and of new spans that overlap the one that begins first stays.

Places are code points, end exclusive. They come from the lengths of what lies between the
matches (split) and of the matches themselves, in one pass over each row's own arrays.

Defined results: null text is an empty text, without spans. Repeated rows are judged alike. An empty table gives an empty
result. Columns besides doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: Same matches as the plain forms, but each run is scanned once: a match can only begin where its run
#: begins or where the match before ended.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = (rf"(?:{sign}|\x20?[\[({{<]\x20?(?i:{word})\x20?[\])}}>]\x20?)" for sign, word in (("@", "at"), (r"\.", "dot")))
#: What may be an identifier: number groups, names joined by an at sign, groups with colons.
BROAD = "|".join((rf"(?<!{LOCAL}){LOCAL}++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:])", r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++"))
#: What a text must hold for a pattern to be tried at all.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
}
BROAD_NEEDS = r"@|[\[({<]\x20?(?i:at)\x20?[\])}>]|:[0-9A-Fa-f]*:|[0-9][\x20().-]{0,2}[0-9]"
LEAST_DIGITS = 6
#: The words next to a mention, at the end and at the beginning of what lies before and after it.
BEFORE, TWO_BEFORE, AFTER = r"(?<!\S)(\S++)\s*+$", r"(?<!\S)(\S++\s++\S++)\s*+$", r"^\s*+(\S++)"
SPAN = "struct<start:int,stop:int,value:string,before:string,before2:string,after:string>"
#: Elements of a run in gathered().
RUN = 128


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = d * 2
        return F.when((n - i) % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_real(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15)


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def gathered(items: Column, start: Column, kind: str, step, last=None) -> Column:
    """The array of what step(at, item) gives as (next at, element or null) over items; last(at) adds one at the end.

    A state that holds an array is copied at each step. So the places where short runs begin come first, from a state
    that is a number, and arrays only ever grow inside a run: time grows with the number of elements, not its square.
    """

    def go(state: Column, item: Column) -> Column:
        at, one = step(state["at"], item)
        return F.struct(at.alias("at"), F.when(one.isNull(), state["out"]).otherwise(F.array_append(state["out"], one)).alias("out"))

    def begins(runs: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        over = lambda state, run: F.struct(F.aggregate(run, state["at"], lambda at, x: step(at, x)[0]).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))
        return F.aggregate(runs, none, over)

    def whole(runs: Column, at: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        each = F.zip_with(runs, at["out"], lambda run, first: F.aggregate(run, F.struct(first.alias("at"), none.alias("out")), go, lambda s: s["out"]))
        return F.flatten(each) if last is None else F.concat(F.flatten(each), F.array(last(at["at"])))

    def cut(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / RUN).cast("int")), lambda k: F.slice(every, k * RUN + 1, F.lit(RUN)))

    return bound(bound(items, cut), lambda runs: bound(begins(runs), partial(whole, runs)))


def matches(text: Column, pattern: str, wanted: Column, words: bool) -> Column:
    """All matches with their places and, if ``words`` are asked, those next to each."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    word = lambda gap, what: F.regexp_extract(gap, what, 1) if words else F.lit(None).cast("string")

    def spans(f: Column, g: Column) -> Column:
        n = F.size(f)
        left = F.zip_with(f, F.slice(g, F.lit(1), n), lambda v, x: F.struct(v.alias("value"), F.length(x).alias("gap"), word(x, BEFORE).alias("before"), word(x, TWO_BEFORE).alias("before2")))
        both = F.zip_with(left, F.slice(g, F.lit(2), n), lambda p, x: F.struct(p.alias("p"), word(x, AFTER).alias("after")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            begin = at + x["p"]["gap"]
            stop = begin + F.length(x["p"]["value"])
            return stop, F.struct(begin.alias("start"), stop.alias("stop"), x["p"]["value"].alias("value"), x["p"]["before"].alias("before"), x["p"]["before2"].alias("before2"), x["after"].alias("after"))

        return gathered(both, F.lit(0), SPAN, step)

    told = bound(F.struct(found.alias("f"), gaps.alias("g")), lambda x: spans(x["f"], x["g"]))
    return F.when(wanted, told).otherwise(F.array().cast(f"array<{SPAN}>"))


def _real_span(kind: str, span: Column) -> Column:
    return is_real(kind, span["value"])


def base_spans(text: Column, words: bool = False) -> dict[str, Column]:
    return {k: F.filter(matches(text, BASE[k], NEEDS[k](text), words), partial(_real_span, k)) for k in KINDS}


def folded(words: Column) -> Column:
    """Lower-cased, digits and gaps alike."""
    return F.regexp_replace(F.regexp_replace(common.ascii_lower(words), "[0-9]+", "0"), r"\s+", " ")


def mentions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, mentions). rows: row, doc_id, key (a hash of the text) and base_<kind> spans; written once. mentions: row, base (the kind,
    null for candidates), start, stop, value, before, before2, after; no candidate overlaps a base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    every = {f"base_{k}": c for k, c in base_spans(F.col("text"), True).items()} | {"broad": matches(F.col("text"), BROAD, F.col("text").rlike(BROAD_NEEDS), True)}
    rows, _ = common.save(bare.select("doc_id", "key", *(c.alias(n) for n, c in every.items())).withColumn("row", F.monotonically_increasing_id()))
    told = [rows.select("row", F.lit(k).alias("base"), F.inline(f"base_{k}")) for k in KINDS]
    told.append(rows.select("row", F.lit(None).cast("string").alias("base"), F.inline("broad")))
    every = reduce(DataFrame.union, told)
    # a document's mentions in order: what base spans reach, from either side
    up, down = (Window.partitionBy("row").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) for by in (("start", F.col("base").isNull()), (F.col("start").desc(), F.col("base").isNotNull())))
    reached = F.max(F.when(F.col("base").isNotNull(), F.col("stop"))).over(up)
    awaits = F.min(F.when(F.col("base").isNotNull(), F.col("start"))).over(down)
    every = every.withColumn("_reached", reached).withColumn("_awaits", awaits)
    free = (F.coalesce("_reached", F.lit(0)) <= F.col("start")) & (F.coalesce("_awaits", F.col("stop")) >= F.col("stop"))
    digits = F.length(F.regexp_replace("value", "[^0-9]", "")) >= LEAST_DIGITS
    named = F.col("value").rlike(r"[@:\[({<].*[A-Za-z]|::|(?::[0-9A-Fa-f]+){3}")
    every = every.where(F.col("base").isNotNull() | free & (digits | named)).drop("_reached", "_awaits")
    return rows, common.save(every)[0]


def _may_be(kind: str, value: Column) -> Column:
    """Whether a candidate of this form may be of the kind."""
    joined_, colons = value.rlike(rf"[A-Za-z0-9]{AT}[A-Za-z0-9]"), F.instr(value, ":") > 0
    return joined_ if kind == "email" else colons | ~joined_ if kind == "ip" else ~joined_ & ~colons


def _scores(value: Column) -> list[Column]:
    return [value.alias(k) for k in KINDS]


def learn(found: DataFrame, rounds: int, least: float, doubt: float, seeds: int) -> DataFrame:
    """value, kind of the accepted candidates of mentions()."""
    shapes = (("b", F.col("before")), ("bb", F.col("before2")), ("a", F.col("after")), ("ba", F.when((F.col("before") != "") & (F.col("after") != ""), F.concat_ws(" _ ", "before", "after"))))
    cues = F.array(*(F.struct(F.lit(n).alias("shape"), folded(c).alias("cue")) for n, c in shapes))
    links = found.select("value", "base", F.explode(cues).alias("x")).select("value", "base", "x.shape", "x.cue").where("cue <> ''").distinct()
    # a cue says something only if seeds and others have it, or if others that share it may become seeds
    links, _ = common.save(links)
    known = links.where("base is not null")
    open_ = links.where("base is null").drop("base")
    met = open_.select("shape", "cue").distinct()
    # base instances of cues that any candidate has: one row each, summed up once
    fixed = known.join(met, ["shape", "cue"], "left_semi").groupBy("shape", "cue").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("base") == k, 1)).cast("double").alias(k) for k in KINDS))
    fixed, _ = common.save(fixed)
    shared = open_.groupBy("shape", "cue").agg(F.count("*").alias("n"))
    few, _ = common.save(shared.join(fixed.select("shape", "cue", F.lit(True).alias("_seeded")), ["shape", "cue"], "left").where("n > 1 or _seeded").drop("_seeded"))
    per_value = open_.groupBy("value", "shape").agg(F.count("*").alias("links"))
    open_, _ = common.save(open_.join(few.drop("n"), ["shape", "cue"], "left_semi").join(per_value, ["value", "shape"]))
    scores = None
    for _ in range(rounds):
        sums = few.select("shape", "cue", "n", *_scores(F.lit(0.0)), *(F.lit(0.0).alias(f"{k}_sure") for k in KINDS))
        if scores is not None:
            scored = open_.join(scores, "value").groupBy("shape", "cue").agg(*(F.sum(k).alias(k) for k in KINDS), *(F.sum((F.col(k) >= least).cast("double")).alias(f"{k}_sure") for k in KINDS))
            sums = sums.union(scored.select("shape", "cue", F.lit(0).cast("long").alias("n"), *KINDS, *(f"{k}_sure" for k in KINDS)))
        sums = sums.union(fixed.select("shape", "cue", "n", *KINDS, *(F.col(k).alias(f"{k}_sure") for k in KINDS)))
        whole = sums.groupBy("shape", "cue").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for k in KINDS for c in (k, f"{k}_sure")))
        worth = [F.when(F.col(f"{k}_sure") >= seeds, F.col(k) / (F.col("n") + F.lit(float(doubt)))).otherwise(F.lit(0.0)).alias(k) for k in KINDS]
        patterns, _ = common.save(whole.select("shape", "cue", *worth).where(" + ".join(KINDS) + " > 0"))
        shaped = open_.join(patterns, ["shape", "cue"]).groupBy("value", "shape", "links").agg(F.count("*").alias("known"), *(F.sum(k).alias(k) for k in KINDS))
        of = F.col("known") + (F.col("links") - F.col("known")) * 0.1
        scores, _ = common.save(shaped.groupBy("value").agg(*(F.max(F.when(_may_be(k, F.col("value")), F.col(k) / of).otherwise(F.lit(0.0))).alias(k) for k in KINDS)))
    best = F.greatest(*KINDS)
    if scores is None:
        return found.sparkSession.createDataFrame([], "value string, kind string")
    kind = reduce(lambda c, k: c.when(F.col(k) == best, k), KINDS, F)
    return scores.where(best >= least).select("value", kind.alias("kind"))


def new_spans(found: DataFrame, rounds: int = 3, least: float = 0.8, doubt: float = 2.0, seeds: int = 3) -> DataFrame:
    """row, new: array of (kind, start, stop) that contexts add, for each row that has any. found: of mentions()."""
    accepted, _ = common.save(learn(found, rounds, least, doubt, seeds))
    new = found.where("base is null").join(accepted, "value")
    order = Window.partitionBy("row").orderBy("start", F.col("stop").desc()).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("_reached", F.max("stop").over(order)).where("_reached is null or _reached <= start")
    return common.save(new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("new")))[0]


def _of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def _place(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["stop"].alias("stop"))


def _named(kind: str, span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["stop"].alias("stop"), F.lit(kind).alias("kind"))


def _told(kind: str, span: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), span["start"].cast("string"), span["stop"].cast("string"))


def joined(columns: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind, then start."""
    parts = [F.transform(F.array_sort(c), partial(_told, k)) for k, c in columns.items()]
    return F.array_join(F.concat(*parts), ",")


def _new(kind: str) -> Column:
    return F.transform(F.filter(F.coalesce("new", F.array().cast("array<struct<kind:string,start:int,stop:int>>")), partial(_of_kind, kind)), _place)


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_<kind> (base spans), base (their list) and spans (all), for each row of docs. options: of new_spans()."""
    rows, found = mentions(docs)
    told = rows.join(new_spans(found, **options), "row", "left")
    base = {k: F.transform(f"base_{k}", _place) for k in KINDS}
    both = {k: F.concat(c, _new(k)) for k, c in base.items()}
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return told.select("doc_id", *counts, joined(base).alias("base"), joined(both).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with each span's text replaced by its kind in angle brackets; of spans that overlap the first one's. All columns stay."""
    rows, found = mentions(docs)
    # base spans come from each row's own text; only rows with new ones are joined
    new = new_spans(found, **options).join(rows.select("row", "doc_id", "key"), "row").select(F.col("doc_id").alias("_id"), F.col("key").alias("_same"), "new").dropDuplicates(["_id", "_same"])
    new, _ = common.save(new)
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    both = kept.join(new, (F.xxhash64(text) == F.col("_same")) & F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
    told = F.concat(*(F.transform(F.concat(F.transform(c, _place), _new(k)), partial(_named, k)) for k, c in base_spans(text).items()))
    both = both.select("_row", F.array_sort(told).alias("_spans"))
    masked = F.when(F.size("_spans") > 0, masked_text(text, F.col("_spans"))).otherwise(F.col("_row.text"))
    return both.select(*((masked if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def masked_text(text: Column, spans: Column, block: int = 4096) -> Column:
    """text with spans(start, stop, kind), in order, replaced."""

    def over(blocks: Column) -> Column:
        def part(a: Column, b: Column) -> Column:  # cut out of the blocks that hold it
            first = F.floor(a / block).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, F.floor(b / block).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(some, a - first * block + 1, b - a)).otherwise("")

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            piece = F.concat(part(at, x["start"]), F.lit("<"), x["kind"], F.lit(">"))
            return F.greatest(at, x["stop"]), F.when(x["start"] >= at, piece)

        return F.array_join(gathered(spans, F.lit(0), "string", step, lambda at: part(at, F.length(text))), "")

    return bound(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block}}}"), F.lit(0)), over)
