"""Personal data: fixed patterns, and contexts learned from what they find.

Emails, addresses, card and phone numbers that fixed patterns find are seeds.
The words around them become lexical patterns: the word before, the two words
before, the word before with the word after, each for one shape of identifier.
Seeds and other identifiers form a graph with the patterns around them.  In each
round a pattern's confidence is the share of its distinct identifiers that are
known, by their scores, and an unknown identifier's score follows from its
patterns, so identifiers found in one round support further patterns in the next.
Patterns of high confidence then mark unseen identifiers in every text.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.storage import Scratch

KINDS = ("email", "ip", "card", "phone")
#: A learned span whose pattern stands for identifiers of several kinds.
OTHER = "other"
# The patterns of the four kinds, written so that no text makes them backtrack
# over a run of characters again and again; what they match is the same.
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?:[0-9]{2}|[0-9][ -][0-9])[0-9]*+(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BLANK, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: An identifier that no kind claims: groups of digits a blank apart, or a word with a digit.
_DIGITS = rf"(?<!{_SOLID})(?:\(?[0-9][0-9().-]*+(?: \(?[0-9][0-9().-]*+)++|[^\x20\x09-\x0D0-9]*+[0-9]{_SOLID}*+)"
#: Any word, for contexts that seeds without digits teach.
_WORD = rf"{_SOLID}++"
_MARK, _STAND_IN = "\x01", "\x02"
#: Letters and digits from which an identifier counts as long.
LONG = 7
#: Files that hold the patterns of one round.
_PATTERN_FILES = 32
#: Pieces of a text whose lengths are summed up together.
_STRIDE = 64
_MATCHES = "array<struct<start:int,end:int,found:string,near:string,before:string,after:string>>"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of its last digit."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    count = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when(count.between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, n: a + n)


def _plain(word: Column) -> Column:
    """A context word without digits and case."""
    return F.lower(F.regexp_replace(word, "[0-9]", ""))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start, end, found and the words around.

    Positions count code points, the end is exclusive.  ``near`` is the word
    before a match, ``before`` the one before that, ``after`` the next; empty
    where there is none.

    Each match is put between marks and the text cut at them; odd pieces are
    matches, and sums of lengths are positions.  Lengths are summed up by strides
    of pieces first, so a position adds up a stride's rest and no list grows
    match by match.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _STAND_IN), pattern, f"{_MARK}$0{_MARK}")

    def strides(lengths: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STRIDE).cast("int"))
        sums = F.transform(numbers, lambda b: _total(F.slice(lengths, b * _STRIDE + 1, F.lit(_STRIDE))))
        return _once(sums, lambda s: F.transform(numbers, lambda b: _total(F.slice(s, F.lit(1), b))))

    def hit(pieces: Column, lengths: Column, offsets: Column, i: Column) -> Column:
        stride = F.floor(i / _STRIDE).cast("int")
        at = F.get(offsets, stride) + _total(F.slice(lengths, stride * _STRIDE + 1, i % _STRIDE))
        # Two matches and what is between them hold two words at least, if there are so many.
        back = F.reverse(F.array_join(F.slice(pieces, F.greatest(i - 4, F.lit(0)) + 1, F.least(i, F.lit(4))), ""))
        left = rf"^{_BLANK}*+({_SOLID}*+){_BLANK}*+({_SOLID}*+)"
        right = F.regexp_extract(F.array_join(F.slice(pieces, i + 2, F.lit(2)), ""), rf"^{_BLANK}*+({_SOLID}*+)", 1)
        return F.struct(
            at.alias("start"), (at + F.get(lengths, i)).alias("end"), F.get(pieces, i).alias("found"),
            _plain(F.reverse(F.regexp_extract(back, left, 1))).alias("near"), _plain(F.reverse(F.regexp_extract(back, left, 2))).alias("before"), _plain(right).alias("after"),
        )

    def placed(pieces: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
        found = _once(F.transform(pieces, F.length), lambda n: _once(strides(n), lambda o: F.transform(odd, lambda i: hit(pieces, n, o, i))))
        return F.when(F.size(pieces) > 2, found).otherwise(F.array().cast(_MATCHES))

    return _once(F.split(marked, _MARK, -1), placed)


def _tag(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "found", "near", "before", "after")]))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, kind by kind, each by start; failing matches dropped."""

    def spans(kind: str) -> Column:
        found = F.filter(matches(text, _PATTERN[kind]), lambda m: _holds(kind, m["found"]))
        if _NEEDS[kind]:
            found = F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(F.array().cast(_MATCHES))
        return _tag(found, kind)

    return F.flatten(F.array(*map(spans, KINDS)))


def _meets(spans: Column, m: Column) -> Column:
    """Whether a match overlaps one of disjoint spans that come in order, by halving."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        passed = (state["low"] < state["high"]) & (F.get(spans, middle)["end"] <= m["start"])
        low = F.when(passed, middle + 1).otherwise(state["low"])
        high = F.when((state["low"] < state["high"]) & ~passed, middle).otherwise(state["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    whole = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.aggregate(halvings, whole, halve, lambda s: F.coalesce(F.get(spans, s["low"])["start"] < m["end"], F.lit(False)))


def _outside(found: Column, base: Column) -> Column:
    """Matches that overlap no base span; spans of one kind are disjoint and in order."""

    def without(kind: str, left: Column) -> Column:
        own = F.filter(base, lambda b: b["kind"] == kind)
        return _once(own, lambda spans: F.when(F.size(spans) > 0, F.filter(left, lambda m: ~_meets(spans, m))).otherwise(left))

    def after(kinds: tuple[str, ...], left: Column) -> Column:
        return _once(without(kinds[0], left), lambda rest: after(kinds[1:], rest)) if kinds else left

    return after(KINDS, found)


def candidates(text: Column, base: Column) -> Column:
    """Identifiers with digits that overlap no base span."""
    return _once(matches(text, _DIGITS), lambda found: _outside(found, base))


def shape(found: Column) -> Column:
    """``w`` without digits; else ``l`` from LONG letters and digits on, ``s`` below."""
    size = F.length(F.regexp_replace(found, r"[^\p{L}\p{N}]", ""))
    return F.when(~found.rlike("[0-9]"), "w").when(size >= LONG, "l").otherwise("s")


def patterns_of(m: Column) -> Column:
    """The lexical patterns around a match, for its shape; no words, no patterns."""
    kind = shape(m["found"])
    near = F.when(m["near"] != "", F.concat(kind, F.lit("1 "), m["near"]))
    two = F.when((m["near"] != "") & (m["before"] != ""), F.concat(kind, F.lit("2 "), m["before"], F.lit(" "), m["near"]))
    both = F.when((m["near"] != "") & (m["after"] != ""), F.concat(kind, F.lit("3 "), m["near"], F.lit(" "), m["after"]))
    return F.filter(F.array(near, two, both), lambda p: p.isNotNull())


def score_patterns(instances: DataFrame, scratch: Scratch, rounds: int = 3, least_seeds: int = 3) -> DataFrame:
    """``(pattern, kind, confidence)`` from ``(pattern, found, kind)`` instances.

    ``kind`` is null for identifiers that no seed names.  A seed's score for its
    kind is 1.  In each round a pattern's support is the sum of the scores of its
    distinct identifiers, its confidence the support over their number plus one;
    patterns of less support than ``least_seeds`` over all kinds are left out.
    An unknown identifier's score is then one less the product of its patterns'
    doubts, whichever kinds they are of, dealt to kinds by their confidence.
    """
    edges = instances.groupBy("pattern", "found").agg(F.collect_set("kind").alias("kinds"))
    edges = scratch.table(edges, "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("all"))
    sown = edges.select("pattern", F.explode("kinds").alias("kind")).groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("support"))
    unknown = edges.where(F.size("kinds") == 0).select("pattern", "found")
    patterns = None
    for turn in range(rounds + 1):
        support = sown
        if turn:
            reached = unknown.join(patterns, "pattern")
            doubt = reached.groupBy("found", "pattern").agg(F.sum("confidence").alias("c"))
            doubt = doubt.groupBy("found").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("c"), F.lit(0.999)))))).alias("score"), F.sum("c").alias("whole"))
            shares = reached.groupBy("found", "kind").agg(F.sum("confidence").alias("c"))
            scored = shares.join(doubt, "found").select("found", "kind", (F.col("score") * F.col("c") / F.col("whole")).alias("support"))
            support = sown.unionByName(unknown.join(scored, "found").select("pattern", "kind", "support"))
        held = support.groupBy("pattern", "kind").agg(F.sum("support").alias("support"))
        held = held.groupBy("pattern").agg(F.sum("support").alias("total"), F.collect_list(F.struct("kind", "support")).alias("held"))
        held = held.where(F.col("total") >= least_seeds).join(sizes, "pattern").select("pattern", "all", F.explode("held").alias("h"))
        held = held.select("pattern", "h.kind", (F.col("h.support") / (F.col("all") + 1)).alias("confidence"))
        # Patterns of enough support are few beside the texts: a bounded number of files holds them.
        patterns = scratch.table(held.coalesce(_PATTERN_FILES), f"patterns{turn}")
    return patterns


def sure_patterns(patterns: DataFrame, least_confidence: float) -> DataFrame:
    """``(pattern, kind, confidence)`` of patterns that mark identifiers.

    A kind that alone reaches ``least_confidence`` names what the pattern marks;
    where only all kinds together do, it is ``other``.
    """
    best = F.max(F.struct("confidence", "kind"))
    held = patterns.groupBy("pattern").agg(F.least(F.lit(1.0), F.sum("confidence")).alias("confidence"), best.alias("best"))
    kind = F.when(F.col("best.confidence") >= least_confidence, F.col("best.kind")).otherwise(F.lit(OTHER))
    return held.where(F.col("confidence") >= least_confidence).select("pattern", kind.alias("kind"), "confidence")


def _joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    rank = {k: i for i, k in enumerate(kinds)}
    place = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(place[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words_in_context(rows: DataFrame, seeds: DataFrame, least_seeds: int, scratch: Scratch) -> DataFrame | None:
    """``(key, start, end, found, pattern)`` of words without digits after contexts that seeds without digits teach.

    Only then are all words of all texts looked at; where no such context has
    seeds enough, None.
    """
    taught = seeds.where("pattern like 'w%'").select("pattern", "found").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    taught = scratch.table(taught.where(F.col("n") >= least_seeds).select("pattern").coalesce(_PATTERN_FILES), "taught")
    if taught.isEmpty():
        return None
    outside = _once(matches(F.col("text"), _WORD), lambda found: _outside(found, F.col("base")))
    words = rows.dropDuplicates(["key"]).select("key", F.explode(outside).alias("m")).where(~F.col("m.found").rlike("[0-9]"))
    spots = words.select("key", "m.start", "m.end", "m.found", F.explode(patterns_of(F.col("m"))).alias("pattern"))
    return scratch.table(spots.join(taught, "pattern", "left_semi").select("key", "start", "end", "found", "pattern"), "words")


def find_personal_data(
    docs: DataFrame, least_confidence: float = 0.6, least_seeds: int = 3, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_email .. n_phone, base_sha256, spans, n_base, n_learned, n_spans.

    ``n_email`` .. ``n_phone`` and ``base_sha256`` cover the base spans; ``spans``
    has these and the spans that learned contexts add, never overlapping a base
    span, and ``n_spans`` counts both, ``n_base`` and ``n_learned``.  A learned span has the kind its pattern
    stands for, ``other`` where that is no single one; ``other`` comes after the
    kinds.  Candidates are words with a digit and groups of digits a blank apart;
    after contexts that seeds without digits teach, every word.  A pattern needs
    ``least_seeds`` of support and ``least_confidence``; of several sure patterns
    around one identifier the most confident names it.

    Null and empty texts have no spans.  Equal texts get equal results, rows that
    repeat come out as often as they go in, ids may be null, other columns are
    ignored, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Every expression below reads a column of the step before, so none is computed twice.
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256))).withColumn("base", base_spans(F.col("text")))
    more = F.when(F.col("text").rlike("[0-9]"), candidates(F.col("text"), F.col("base"))).otherwise(F.array().cast(_MATCHES))
    found = scratch.table(rows.withColumn("more", more).select("id", "key", "base", "more"), "found")
    seeds = found.select(F.explode("base").alias("m")).select(F.explode(patterns_of(F.col("m"))).alias("pattern"), "m.found", "m.kind")
    spots = found.select("key", F.explode("more").alias("m")).select("key", "m.start", "m.end", "m.found", F.explode(patterns_of(F.col("m"))).alias("pattern"))
    words = _words_in_context(rows, seeds, least_seeds, scratch)
    spots = spots if words is None else spots.unionByName(words)
    others = spots.select("pattern", "found", F.lit(None).cast("string").alias("kind"))
    sure = sure_patterns(score_patterns(seeds.unionByName(others), scratch, rounds, least_seeds), least_confidence)
    named = spots.join(sure, "pattern").groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "pattern")).alias("kind"))
    learned = named.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("learned"))
    out = found.join(learned, "key", "left").withColumn("learned", F.coalesce("learned", F.array().cast(_SPANS)))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("id").alias(id_col), *map(count, KINDS), F.sha2(_joined(plain, KINDS), 256).alias("base_sha256"),
        _joined(F.concat(plain, F.col("learned")), (*KINDS, OTHER)).alias("spans"),
        F.size("base").cast("long").alias("n_base"), F.size("learned").cast("long").alias("n_learned"), (F.size("base") + F.size("learned")).cast("long").alias("n_spans"),
    )
