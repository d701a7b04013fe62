"""Location of candidates, tag numbers and redacted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velum import fixed_values as V
from velum.functions import spans as S
from velum.functions.needles import locate_all, locate_changed, piece_index
from velum.functions.text import needle_pattern, normalise, trim
from velum.operators.detect import row_candidates, tag_label
from velum.rules import ADDRESS_TAIL, STREET_CORE

_RANGES = "array<struct<start:int,end:int>>"


def locate(text: Column, needle: Column) -> Column:
    """array<struct<start,end>>: all occurrences of a needle, ignoring case and the kind of white space; none for a blank needle."""
    blank = F.coalesce(trim(needle) == "", F.lit(True))
    return F.when(blank, F.array().cast(_RANGES)).otherwise(S.matches(text, needle_pattern(needle)))


def exact_substrings(text: Column, needle: Column) -> Column:
    return F.transform(locate(text, needle), lambda m: S.cut(text, m["start"], m["end"]))


def expand_address(text: Column, ranges: Column) -> Column:
    """Each range lengthened by the postal code, district, floor and the like that follow it at once."""
    tail = lambda m: F.length(F.regexp_extract(text.substr(m["end"] + 1, F.length(text)), ADDRESS_TAIL, 0))
    return F.transform(ranges, lambda m: F.struct(m["start"].alias("start"), (m["end"] + tail(m)).cast("int").alias("end")))


def street_core(address: Column) -> Column:
    """Street and number of an address in normal form, or null if that is too short to stand for it."""
    core = F.regexp_extract(normalise(address), STREET_CORE, 0)
    return F.when(F.length(core) >= V.MIN_STREET_CORE, core)


def occurrence_ranges(text: Column, needle: Column, kind: Column) -> Column:
    """Where a candidate stands in its document; addresses are expanded, and their street and number found alone, too."""
    core = street_core(needle)
    return _ranges(text, kind, locate(text, needle), F.when(core.isNotNull(), locate(text, core)).otherwise(F.array().cast(_RANGES)))


def _ranges(text: Column, kind: Column, plain: Column, cores: Column) -> Column:
    expanded = expand_address(text, plain)
    extra = F.filter(cores, lambda c: ~F.exists(expanded, lambda r: (r["start"] <= c["start"]) & (r["end"] >= c["end"])))
    both = F.concat(expanded, expand_address(text, extra))
    return F.array_sort(F.when(kind == "address", both).otherwise(plain))


def needles_of(cands: Column) -> Column:
    """array<string>: what is looked for of array<struct<original_text,type,...>>: each text, then each address's street (empty for others)."""
    streets = F.transform(cands, lambda c: F.when(c["type"] == "address", F.coalesce(street_core(c["original_text"]), F.lit(""))).otherwise(""))
    return F.concat(F.transform(cands, lambda c: c["original_text"]), streets)


def ranges_of(text: Column, cands: Column, found: Column) -> Column:
    """array<array<struct<start,end>>>: :func:`occurrence_ranges` of each candidate, from the occurrences of its needles."""
    each = lambda f: F.transform(cands, lambda c, i: _ranges(text, c["type"], F.element_at(f, i + 1), F.element_at(f, F.floor(F.size(f) / 2).cast("int") + i + 1)))
    return S.once(found, each)


def text_hash(text: Column) -> Column:
    """What tells whether occurrences are of the text as it is."""
    return F.sha2(text, 256)


def occurrences(docs: DataFrame, cands: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, cand_id, type, start, end, text_hash). A document's candidates meet its text as one array, so texts aren't repeated, and one
    scan finds them all."""
    listed = cands.groupBy(key).agg(F.collect_list(F.struct("cand_id", "original_text", "type")).alias("cands"))
    joined = docs.select(key, text).join(listed, key).withColumn("found", locate_all(F.col(text), needles_of(F.col("cands"))))
    ranges = ranges_of(F.col(text), F.col("cands"), F.col("found"))
    each = joined.select(key, text_hash(F.col(text)).alias("text_hash"), F.explode(F.arrays_zip("cands", ranges.alias("ranges"))).alias("c"))
    return each.select(key, "c.cands.cand_id", "c.cands.type", F.explode("c.ranges").alias("r"), "text_hash").select(key, "cand_id", "type", "r.start", "r.end", "text_hash")


def synchronise(docs: DataFrame, cands: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences after candidates or texts changed: those of ``known`` with equal id and type in an unchanged text stay, the others are looked for."""
    same = [key, "cand_id", "type"]
    current = known.join(docs.select(key, text_hash(F.col(text)).alias("text_hash")).distinct(), [key, "text_hash"], "left_semi").select(*known.columns)
    kept = current.join(cands.select(*same), same, "left_semi")
    fresh = cands.join(current.select(*same).distinct(), same, "left_anti")
    return kept.unionByName(occurrences(docs, fresh, key, text))


def text_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pieces): what :func:`resynchronise` needs of texts as they are, to find out later what of them changed."""
    return docs.select(key, piece_index(F.col(text)).alias("pieces"))


def resynchronise(docs: DataFrame, cands: DataFrame, known: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`synchronise` where only changed regions of changed texts are scanned: (key, cand_id, type, start, end, text_hash, scanned, n_chars).

    index: the :func:`text_index` of the texts that ``known`` is of. Occurrences in pieces that a text still has are moved along, the others
    looked for where it changed. Candidates that weren't known, and addresses (which grow into what follows them), are looked for in whole texts;
    scanned counts a document's characters that were looked at again for those that were known.
    """
    same = [key, "cand_id", "type"]
    sized = docs.select(key, text, text_hash(F.col(text)).alias("text_hash"), F.length(text).alias("n_chars"))
    held = cands.join(known.select(*same).distinct(), same, "left_semi")
    unchanged = known.join(sized.select(key, "text_hash", "n_chars"), [key, "text_hash"]).join(held.select(*same), same, "left_semi")
    here = unchanged.select(*same, "start", "end", "text_hash", F.lit(0).alias("scanned"), "n_chars")
    # What moved along in texts that changed: one array of needles and places a document.
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "end"))), lambda r: F.array(r["start"], r["end"])))
    places = known.filter("type <> 'address'").groupBy(*same, F.col("text_hash").alias("old_hash")).agg(flat.alias("places"))
    listed = held.join(places, same).groupBy(key, "old_hash").agg(F.collect_list(F.struct("cand_id", "type", "original_text", "places")).alias("cands"))
    changed = sized.join(listed, key).filter(F.col("old_hash") != F.col("text_hash")).join(index, key, "left")
    found = locate_changed(F.col(text), F.transform("cands", lambda c: c["original_text"]), F.col("pieces"), F.transform("cands", lambda c: c["places"]))
    each = changed.withColumn("out", found).select(key, "text_hash", "n_chars", "out.scanned", F.explode(F.arrays_zip("cands", F.col("out.found").alias("found"))).alias("x"))
    moved = each.select(key, "x.cands.cand_id", "x.cands.type", "text_hash", "scanned", "n_chars", F.explode("x.found").alias("r"))
    moved = moved.select(*same, "r.start", "r.end", "text_hash", "scanned", "n_chars")
    # New candidates, and addresses in texts that changed.
    done = here.select(*same).union(held.filter("type <> 'address'").select(*same)).distinct()
    fresh = occurrences(docs, cands.join(done, same, "left_anti"), key, text).join(sized.select(key, "n_chars"), key)
    return here.unionByName(moved).unionByName(fresh.select(*same, "start", "end", "text_hash", F.col("n_chars").alias("scanned"), "n_chars"))


def tags(cands: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates with their tag: numbered per type among the selected in list order, a dash for the others."""
    before = W.partitionBy(key, "type").orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow)
    number = F.sum(F.col("is_selected").cast("int")).over(before)
    return cands.withColumn("tag", F.concat(F.lit("["), tag_label(F.col("type")), F.lit(" "), F.when(F.col("is_selected"), number.cast("string")).otherwise("-"), F.lit("]")))


def offset_map(puts: Column) -> Column:
    """array<struct<start,end,ordinal,tag,at,to>>: of array<struct<start,end,ordinal,tag>> what is put in, with its places in the original
    and, from ``at`` to ``to``, in the redacted text. Between them places move along, so this maps any place either way."""

    def placed(kept: Column, moved: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            to = x["end"] + F.element_at(moved, i + 1)
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ordinal"].alias("ordinal"), x["tag"].alias("tag"), (to - F.length(x["tag"])).alias("at"), to.alias("to"))

        return F.transform(kept, one)

    longer = lambda x: F.length(x["tag"]) - (x["end"] - x["start"])
    return S.once(S.resolve(puts), lambda kept: F.when(F.size(kept) == 0, F.array().cast(OFFSETS)).otherwise(S.once(S.running(F.transform(kept, longer), lambda a, b: a + b), lambda moved: placed(kept, moved))))


def to_redacted(offsets: Column, place: Column, after: bool = False) -> Column:
    """The place in the redacted text of a place in the original; within what was replaced, the tag's start (or its end, if ``after``)."""
    last = F.try_element_at(F.filter(offsets, lambda x: x["start"] < place if after else x["start"] <= place), F.lit(-1))
    inside = place <= last["end"] if after else place < last["end"]
    return F.when(last.isNull(), place).when(inside, last["to"] if after else last["at"]).otherwise(place + last["to"] - last["end"])


def to_original(offsets: Column, place: Column, after: bool = False) -> Column:
    """The place in the original text of a place in the redacted; within a tag, the start of what it stands for (or its end, if ``after``)."""
    last = F.try_element_at(F.filter(offsets, lambda x: x["at"] < place if after else x["at"] <= place), F.lit(-1))
    inside = place <= last["to"] if after else place < last["to"]
    return F.when(last.isNull(), place).when(inside, last["end"] if after else last["start"]).otherwise(place + last["end"] - last["to"])


def stitch(text: Column, offsets: Column) -> Column:
    """The redacted text: what stands between the places of :func:`offset_map`, and the tags."""

    def joined(x: Column, parts: Column) -> Column:
        n = F.size(x)
        before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(x, F.greatest(i, F.lit(1)))["end"])
        filled = F.transform(x, lambda y, i: F.concat(S.cut_pieces(parts, before(i), y["start"]), y["tag"]))
        return F.concat(F.array_join(filled, ""), S.cut_pieces(parts, F.element_at(x, -1)["end"], F.length(text)))

    return F.when(F.size(offsets) == 0, text).otherwise(S.once(S.pieces(text), lambda parts: joined(offsets, parts)))


OFFSETS = "array<struct<start:int,end:int,ordinal:int,tag:string,at:int,to:int>>"


def _puts(text: Column, cands: Column, found: Column) -> Column:
    """array<struct<start,end,ordinal,tag>> of candidates array<struct<ordinal,original_text,type,tag>> found in a text."""
    put = lambda c, r: F.struct(r["start"].alias("start"), r["end"].alias("end"), c["ordinal"].alias("ordinal"), c["tag"].alias("tag"))
    return F.flatten(F.zip_with(cands, ranges_of(text, cands, found), lambda c, ranges: F.transform(ranges, lambda r: put(c, r))))


def _redacted(text: Column, puts: Column) -> Column:
    """struct(redacted, n, offsets) of a text and what is put in; ``puts`` is made once. n counts the candidates that stand in the text."""
    made = lambda p: S.once(offset_map(p), lambda o: F.struct(stitch(text, o).alias("redacted"), F.size(F.array_distinct(F.transform(p, lambda x: x["ordinal"]))).cast("long").alias("n"), o.alias("offsets")))
    return S.once(puts, made)


def redactions(docs: DataFrame, cands: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, redacted, n_replaced_candidates, offsets) of every document; those without selected candidates keep their text.

    A document's candidates (or its ``known`` occurrences) come as one array, so there is one join and no text is repeated. offsets is
    the :func:`offset_map`, empty where nothing is replaced.
    """
    numbered = tags(cands, key).filter("is_selected").select(key, "cand_id", "ordinal", "tag", "original_text", "type")
    if known is None:
        listed = numbered.groupBy(key).agg(F.collect_list(F.struct("ordinal", "original_text", "type", "tag")).alias("x"))
        joined = docs.select(key, text).join(listed, key, "left").withColumn("found", locate_all(F.when(F.col("x").isNotNull(), F.col(text)), needles_of(F.col("x"))))
        puts = _puts(F.col(text), F.col("x"), F.col("found"))
    else:
        places = known.join(numbered.select(key, "cand_id", "ordinal", "tag"), [key, "cand_id"])
        listed = places.groupBy(key).agg(F.collect_list(F.struct("start", "end", "ordinal", "tag")).alias("x"))
        joined, puts = docs.select(key, text).join(listed, key, "left"), F.col("x")
    out = joined.withColumn("out", F.when(F.col("x").isNotNull() & F.col(text).isNotNull(), _redacted(F.col(text), puts)))
    return out.select(
        key, text, F.coalesce("out.redacted", text).alias("redacted"), F.coalesce("out.n", F.lit(0).cast("long")).alias("n_replaced_candidates"), F.coalesce("out.offsets", F.array().cast(OFFSETS)).alias("offsets")
    )


def redact(docs: DataFrame, cands: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, redacted, n_replaced_candidates) of every document, as :func:`redactions`."""
    return redactions(docs, cands, known, key, text).select(key, "redacted", "n_replaced_candidates")


def highlights(docs: DataFrame, cands: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, needle, start, end, original_start, original_end): where each candidate's needle (its tag if it is selected, else its
    text) stands in the redacted text, and the place in the original that this stands for. All of a document's are found by one scan."""
    numbered = tags(cands, key)
    needle = F.when(F.col("is_selected"), F.col("tag")).otherwise(F.col("original_text"))
    listed = numbered.groupBy(key).agg(F.collect_list(F.struct("ordinal", needle.alias("needle"))).alias("needles"))
    joined = redactions(docs, cands, None, key, text).select(key, "redacted", "offsets").join(listed, key)
    located = joined.withColumn("found", locate_all(F.col("redacted"), F.transform("needles", lambda x: x["needle"])))
    each = located.select(key, "offsets", F.explode(F.arrays_zip("needles", "found")).alias("x")).select(key, "offsets", "x.needles.ordinal", "x.needles.needle", F.explode("x.found").alias("r"))
    back = [to_original(F.col("offsets"), F.col("r.start")).alias("original_start"), to_original(F.col("offsets"), F.col("r.end"), after=True).alias("original_end")]
    return each.select(key, "ordinal", "needle", "r.start", "r.end", *back)


def redact_found(docs: DataFrame, maybe: Column, spans: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, redacted, n_replaced_candidates) where all that is found is redacted: one pass over the texts, without a join.

    maybe, spans: as :func:`velum.operators.detect.spans_of` gives them.
    """

    def tagged(cands: Column) -> Column:
        """With tags, numbered within each type."""

        def of(kind: str, label: str) -> Column:
            own = F.filter(cands, lambda c: c["type"] == kind)
            return F.transform(own, lambda c, i: F.struct(c["ordinal"].alias("ordinal"), c["original_text"].alias("original_text"), c["type"].alias("type"), F.concat(F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("]")).alias("tag")))

        return F.concat(*[of(kind, label) for kind, _, label in V.TYPES])

    # The outer form keeps the candidates, which the automaton and the tags both need, from being made twice.
    made = S.once(S.once(spans, row_candidates), tagged)
    listed = docs.select(key, text, F.explode_outer(F.array(F.when(maybe, made))).alias("x"))
    some = F.size("x") > 0
    located = listed.withColumn("found", locate_all(F.when(some, F.col(text)), F.when(some, needles_of(F.col("x")))))
    done = located.withColumn("out", F.when(some, _redacted(F.col(text), _puts(F.col(text), F.col("x"), F.col("found")))))
    return done.select(key, F.coalesce("out.redacted", text).alias("redacted"), F.coalesce("out.n", F.lit(0).cast("long")).alias("n_replaced_candidates"))
