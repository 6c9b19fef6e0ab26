"""Texts cut off by a field limit or in transfer.

1. Length hazards. Per source, in characters and in bytes, each before and
   after the marks that senders put behind a text are dropped, the hazard of a
   length is the number of texts that end at it over those that reach it.
   Windows sum the hazards of the neighbouring lengths; an excess over them is
   tested by the Chernoff bound of the Poisson tail, with the false discovery
   rate controlled per source and measure (Benjamini and Hochberg).
   Neighbouring significant lengths make one limit, and of limits that the same
   texts meet in several measures the sharpest is kept.
2. Candidates are the texts that end at a limit. Their endings decide: what
   ends with a sentence, a table row or a signature is whole, all else is cut,
   as long as the hazards leave next to no room for texts that end there by
   themselves; where they do leave room, only endings that no whole text has
   count.
3. Cuts in transfer come at any length, where no hazard can stand out, so the
   method cannot give them. Outside of limits a text is reported only if its
   ending is one that no whole text has. ``report`` counts the two apart.

A copy of a text that was cut at a limit is cut as well, whatever its source.

Endings are told apart by form, not by the words of one corpus: sentence marks
of all scripts, closing marks, notes and addresses behind them, rows with as
many fields as the row above, list items, lead-ins, short lines that are no
sentence. ``WORDS`` are the closed word classes that say whether a line is a
sentence (English and Welsh); abbreviations and signing phrases are there too.

Cases: null and blank texts aren't cut; a null source is a source of its own;
copies count once in the hazards; very long texts are read whole, by patterns
that don't recurse over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pandect.functions.text import BLANK, source_key
from pandect.plans.cut import stored

#: Neighbouring lengths on either side of a tested one, and the false discovery rate.
NEIGHBOURS = 25
FDR = 0.01
#: Significant lengths at most this far apart belong to one limit (cuts at the word before it).
BAND = 8
MEASURES = ("chars", "bytes", "bare_chars", "bare_bytes")

#: Closed word classes and phrases of the languages at hand.
WORDS = {
    "abbreviation": "s ss reg regs para paras col cols art arts Sch Schs No Nos rheol",
    "verb": "must shall may can cannot will would should could is are was were be been does do did has have had mae yw oedd bydd gall gellir rhaid caiff",
    "opener": "the a an this that these those every each any no nothing in on at for if where when subject unless until before after without of to from by with y yr mae rhaid caiff ni os pan yn mewn",
    "dangling": "the a an of to in on at for with by and or that which who each every any no not must shall may is are was as from under into than y yr i o yn ar ac neu pob",
    "article": "the a an y yr",
    "joining": "of and the for in to a an at by on y yr a o i ar",
    "date": "on dated ar dyddiedig",
    "copula": "is are was were yw oedd",
}
SIGNING = r"(?i:signed by|signed on behalf of|llofnodwyd gan) "
#: Words of a line that may be a heading.
HEADING_WORDS = 14

_INNER = BLANK.replace(r"\s", r" \t\x{0b}\f\r")
_ZERO = r"\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}"
#: Sentence marks of all scripts, and what may close behind them.
_STOPS = r".!?\x{3002}\x{ff01}\x{ff0e}\x{ff1f}\x{ff61}\x{061f}\x{06d4}\x{0964}\x{0965}\x{0589}\x{1362}\x{104b}\x{17d4}"
_CLOSE = r"”’'\")\]\x{300d}\x{300f}\x{ff09}»"
#: What senders put behind a cut, one mark after the other as they read
#: backwards: from the text's end a pattern can be anchored, so texts aren't
#: searched for it, and as each mark is a match of its own any number is taken.
_MARKS = rf"\G(?:>[^<>]*[A-Za-z]/?<|[{BLANK}{_ZERO}…>\"”]++|\.{{3,}}+|\](?:…|\.\.\.|erom)\[|\)(?:\.?tnoc|deunitnoc|…|\.\.\.)\()"
#: What follows a whole text, as it reads backwards: note marks, leaders, references, rulers.
_NOTES = rf"\G(?:[{BLANK}]++|\]\d++[A-Z]?\[|\d++[A-Z]?(?= \. \. \.)| \.(?= \.)|\)\d++\(|\*++|[—–-]|\)[^()]* ees\(|\.?tnemucod fo dn[Ee]|\d++[A-Z](?![\p{{L}}\p{{N}}]))"
#: An end of a sentence, as it reads backwards.
_SENTENCE = rf"\A[{_CLOSE}]*+[{_STOPS}]"
#: A sure end of a sentence that needs no closer look: a word in small letters,
#: longer than any abbreviation, and a full stop.
_PLAIN = rf"\p{{Ll}}{{{max(map(len, WORDS['abbreviation'].split())) + 1}}}[.!?]\z"
_ADDRESS = r"\A(?:https?://|www\.).|\A[^@]++@[^@]++\z"
#: Characters at the end that hold any abbreviation, date or amount whole.
_NEAR = 64
_ITEM_END = r"[;,](?: (?:and|or|neu|a|ac))?\z"
#: What stands before the last item mark; an item of its own follows the end of a sentence, a line end, or nothing.
_BEFORE_ITEM = r"(?s)\A(.*)\([a-z]{1,3}\) "
_OWN_ITEM = r"\A\z|[.!?][”)]*+[ \n]*+\z|\n\z"
_LEAD_IN = r"[:：—]\z"
_SIGNED = rf"{SIGNING}[^\n]++(?:\n[^\n]++){{1,3}}+\z"
_BULLET = r"(?:[•·▪*–-]|\d{1,3}[.)]|\([\p{L}\d]{1,4}\)) "
#: Two list items in a row, the upper one without a mark at its end.
_BULLETS = rf"(?:\A|\n){_BULLET}[^\n]*[\p{{L}}\p{{N}}]\n{_BULLET}[^\n]*\z"
#: A sentence that goes on after another one in the same line.
_RUNS_ON = rf"[{_STOPS}][{_CLOSE}]*+ ++(?=[\p{{Lu}}“\"(])"


def _any(kind: str) -> str:
    flags = "" if kind == "abbreviation" else "i"  # "No." is one, "no." is not
    return f"(?{flags}:" + "|".join(sorted(WORDS[kind].split(), key=len, reverse=True)) + ")"


_ABBREVIATED = rf"(?:\A|[^\p{{L}}]){_any('abbreviation')}\.\z|\b{_any('date')} \d{{1,2}}(?:\.\d{{1,2}})?\.\z"
#: A full stop behind a bare number may be its decimal point.
_DECIMAL = rf"\b{_any('copula')} \d++\.\z"
_MONEY = r"[£$€]\d[\d,]*+\.\z"


def unmarked(text: Column) -> Column:
    """The text without the marks and blanks behind it."""
    return F.reverse(F.regexp_replace(F.reverse(text), _MARKS, ""))


def backwards(c: Column) -> Column:
    """An unmarked text backwards, without the notes and references behind its last sentence."""
    return F.regexp_replace(F.reverse(c), _NOTES, "")


def flat(c: Column) -> Column:
    """With single blanks and line ends, and none at the start."""
    flat = F.regexp_replace(c, rf"[{_INNER}]{{2,}}+|[{_INNER}&&[^ ]]", " ")
    flat = F.regexp_replace(flat, r" ?\n[ \n]*+", "\n")
    return F.regexp_replace(flat, r"\A[ \n]+", "")


def _row(c: Column) -> Column:
    """Whether the last line is a table row: fields between bars or tabs, as
    many as in the row above (a first row needs three bars), the last not empty."""
    line = F.substring_index(c, "\n", -1)
    above = F.substring_index(F.substring_index(c, "\n", -2), "\n", 1)
    bars = lambda x: F.length(F.regexp_replace(x, r"[^|]", ""))
    first = (bars(above) == 0) | ~F.contains(c, F.lit("\n"))
    return F.contains(c, F.lit("|")) & (bars(line) > 0) & line.rlike(r"\|\s*+[^|\s]") & ~line.rlike(r"\|\s*\z") & F.when(first, bars(line) >= 3).otherwise(bars(line) == bars(above))


def _heading(c: Column, line: Column) -> Column:
    """Whether the last line can stand without a sentence mark: few words, no
    verb of the closed class, not open at its end, and no sentence that just
    began; below a sentence it is no lone word and has no article either."""
    words = F.size(F.split(line, " "))
    titled = ~F.regexp_replace(line, rf"\b{_any('joining')}\b", "").rlike(r"(?:\A| )\p{Ll}") | line.rlike(r" \d{4}\z")
    opened = line.rlike(rf"\A{_any('opener')}\b") & ~titled
    below = c.rlike(rf"[{_STOPS}][{_CLOSE}]*+\n(?:[^ \n]++|{_any('article')} [^\n]++)\z")
    open_end = line.rlike(rf"(?:\A| )(?:{_any('dangling')}|{_any('opener')})\z|[,(\[“\"/&-]\z|\A\p{{L}}{{1,2}}\z|\([^)]*+\z")
    short_row = F.contains(line, F.lit("|")) & F.contains(c, F.lit("\n"))
    return (words <= HEADING_WORDS) & ~short_row & ~line.rlike(rf"(?:\A| ){_any('verb')}(?: |\z)") & ~opened & ~open_end & ~below & ~line.rlike(_RUNS_ON)


def whole_sentence(back: Column) -> Column:
    """Whether a text given ``backwards`` surely ends with a sentence."""
    end = F.reverse(F.left(back, F.lit(_NEAR)))
    return back.rlike(_SENTENCE) & ~end.rlike(_ABBREVIATED) & ~end.rlike(_DECIMAL) & ~end.rlike(_MONEY)


def ending(c: Column) -> Column:
    """How a flat, unmarked text ends: 'blank', 'whole', 'either' (whole
    unless cut exactly there) or 'cut'."""
    back = backwards(c)
    end = F.reverse(F.left(back, F.lit(_NEAR)))
    line = F.substring_index(c, "\n", -1)
    last = F.element_at(F.split(line, _RUNS_ON), -1)
    before = F.regexp_extract(c, _BEFORE_ITEM, 1)
    item = c.rlike(_ITEM_END) & c.rlike(r"\([a-z]{1,3}\) ") & before.rlike(_OWN_ITEM)
    # A decimal point or the end of a sentence; an amount ends one that has a verb.
    money = end.rlike(_MONEY) & ~last.rlike(rf"(?:\A| ){_any('verb')} ")
    return (
        F.when(c == "", "blank")
        .when(_row(c) | c.rlike(_SIGNED), "whole")
        .when(back.rlike(_SENTENCE), F.when(end.rlike(_ABBREVIATED) | money, "cut").when(end.rlike(_DECIMAL), "either").otherwise("whole"))
        .when(F.substring_index(line, " ", -1).rlike(_ADDRESS), "whole")
        .when(item | c.rlike(_LEAD_IN) | c.rlike(_BULLETS), "either")
        .when(_heading(c, line), "either")
        # Scripts without cases and blanks between words: neither words nor headings show.
        .when(c.rlike(r"[\p{Lo}\p{Mn}\p{Mc}]\z"), "either")
        .otherwise("cut")
    )


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, source_name``, hashes of the text and of its core, the four
    lengths and the ending: all that is needed of a text, read once and stored."""
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.coalesce(source_key(F.col("source")), F.lit("")).alias("source_name"), "text", F.right("text", F.lit(64)).rlike(_PLAIN).alias("plain"))
    once = lambda df, c, name: df.select("*", F.explode(F.array(c)).alias(name))
    # Generators keep the patterns from being repeated where their result is used twice. Most
    # texts end plainly with a sentence; only the others are unmarked, and only what isn't
    # surely whole then is flattened for the finer tests.
    rows = once(rows, F.when(F.col("plain"), F.col("text")).otherwise(unmarked(F.col("text"))), "bare")
    rows = once(rows, F.col("plain") | whole_sentence(backwards(F.col("bare"))), "whole")
    rows = once(rows, F.when(~F.col("whole"), flat(F.col("bare"))), "core")
    rows = once(rows, F.when(F.col("whole"), "whole").otherwise(ending(F.col("core"))), "ending")
    size = {"chars": F.length("text"), "bytes": F.octet_length("text"), "bare_chars": F.length("bare"), "bare_bytes": F.octet_length("bare")}
    cut = F.col("ending").isin("cut", "either")
    return stored(rows.select("doc_id", "source_name", "ending", F.xxhash64("text").alias("h"), F.when(cut, F.xxhash64("core")).alias("core_a"), F.when(cut, F.xxhash64(F.lit(1), "core")).alias("core_b"), *[size[m].alias(m) for m in MEASURES]))


def _by_measure(rows: DataFrame) -> DataFrame:
    """Different texts of a source, once per measure with their ``length``."""
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES]))
    return rows.select("source_name", "h", "ending", *MEASURES).distinct().select("source_name", "h", "ending", each)


def hazards(rows: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``source_name, measure, length, ended, reached, expected, log_p``: the
    discrete hazard of each length (``ended`` over ``reached``) against those
    of its neighbours. ``open`` of those that ended didn't end wholly, and by
    the neighbours' hazards ``by_itself`` is how many such would end there anyway."""
    ended = _by_measure(rows).groupBy("source_name", "measure", "length").agg(F.count(F.lit(1)).alias("ended"), F.count_if(F.col("ending") != "whole").alias("open"), F.count_if(F.col("ending") == "either").alias("__either"))
    one = Window.partitionBy("source_name", "measure").orderBy("length")
    ended = ended.withColumn("reached", F.sum("ended").over(one.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    near = [one.rangeBetween(-neighbours, -1), one.rangeBetween(1, neighbours)]
    total = lambda c: sum((F.coalesce(F.sum(c).over(w), F.lit(0)) for w in near), F.lit(0))
    # Lengths at which nothing ends were reached by about as many texts as the tested one.
    exposure = total(F.col("reached")) + (F.lit(2 * neighbours) - total(F.lit(1))) * F.col("reached")
    hazard = lambda c: F.col("reached") * (total(F.col(c)) + 1) / exposure
    tested = ended.withColumn("expected", hazard("ended")).withColumn("by_itself", hazard("__either")).drop("__either")
    k, lam = F.col("ended").cast("double"), F.col("expected")
    return tested.withColumn("log_p", F.when(k > lam, -(k * F.log(k / lam) - k + lam)).otherwise(0.0))


def significant(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """The lengths that pass at the false discovery rate, per source and measure."""
    group = Window.partitionBy("source_name", "measure")
    ranked = tested.withColumn("__rank", F.row_number().over(group.orderBy("log_p", "length"))).withColumn("__tests", F.count(F.lit(1)).over(group))
    passed = F.max(F.when(F.col("log_p") <= F.log(F.lit(fdr) * F.col("__rank") / F.col("__tests")), F.col("__rank"))).over(group)
    return ranked.withColumn("__passed", passed).where(F.col("__rank") <= F.col("__passed")).drop("__rank", "__tests", "__passed")


def _banded(lengths: DataFrame) -> DataFrame:
    """Significant lengths with the limit (``first`` to ``last``) they belong to
    and the limit's least ``sharpest`` log p."""
    along = Window.partitionBy("source_name", "measure").orderBy("length")
    begins = F.when(F.col("length") - F.lag("length").over(along) <= BAND, 0).otherwise(1)
    banded = lengths.withColumn("__begins", begins).withColumn("__band", F.sum("__begins").over(along))
    band = Window.partitionBy("source_name", "measure", "__band")
    return banded.select("source_name", "measure", "length", "open", "by_itself", F.min("length").over(band).alias("first"), F.max("length").over(band).alias("last"), F.min("log_p").over(band).alias("sharpest"))


def _at_limits(rows: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """Texts (``h``, ``source_name``, ``ending``) that end at a limit, with the
    limit and whether next to no text ends there by itself.

    A limit shows in several measures: cut after 500 characters, texts pile up
    at some numbers of bytes as well. Each text goes to the sharpest limit it
    meets, and limits that keep less than half of the texts they met are
    echoes; a limit in characters (bytes) holds before and after marks alike.
    """
    found = stored(_banded(significant(hazards(rows, neighbours), fdr)))
    met = _by_measure(rows).join(found, ["source_name", "measure", "length"])
    unit = F.regexp_replace("measure", "bare_", "")
    met = met.select("source_name", "h", "ending", F.struct("sharpest", "measure", "first", "last").alias("limit"), unit.alias("unit"), "length", (F.col("by_itself") <= F.lit(fdr) * F.col("open")).alias("sure"))
    best = met.groupBy("source_name", "h").agg(F.min("limit").alias("best"), F.collect_set("limit").alias("limits"))
    share = best.select("source_name", F.explode("limits").alias("limit"), "best").groupBy("source_name", "limit").agg((F.count_if(F.col("limit") == F.col("best")) * 2 >= F.count(F.lit(1))).alias("kept"))
    kept = share.where("kept").select("source_name", F.col("limit").alias("kept_limit"), F.regexp_replace("limit.measure", "bare_", "").alias("unit"))
    within = (F.col("length") >= F.col("kept_limit.first")) & (F.col("length") <= F.col("kept_limit.last"))
    return met.join(kept, ["source_name", "unit"]).where(within).groupBy("source_name", "h", "ending").agg(F.min("kept_limit").alias("limit"), F.bool_or("sure").alias("sure"))


def limits(documents: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """``source_name, measure, first, last, texts, cut``: the limits of each
    source, how many different texts end at them and how many of those are cut."""
    return _limits(_at_limits(measured(documents), neighbours, fdr))


def _cut_here(met: DataFrame) -> Column:
    """At a limit all that didn't end wholly, or, where others end there by themselves, what no whole text ends with."""
    return (F.col("ending") == "cut") | ((F.col("ending") == "either") & F.col("sure"))


def _limits(met: DataFrame) -> DataFrame:
    return met.groupBy("source_name", F.col("limit.measure").alias("measure"), F.col("limit.first").alias("first"), F.col("limit.last").alias("last")).agg(F.count(F.lit(1)).alias("texts"), F.count_if(_cut_here(met)).alias("cut"))


def judged(documents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``doc_id, source_name, verdict`` of the documents whose ending is 'cut'
    or 'either': verdict 'field limit', 'copy', 'transfer', or null for whole ones."""
    rows = measured(documents) if rows is None else rows
    open_ended = rows.where("ending in ('cut', 'either')")
    met = _at_limits(rows)
    at = met.where(_cut_here(met)).select("source_name", "h", F.lit(True).alias("limited"))
    here = open_ended.join(at, ["source_name", "h"], "left")
    cut_texts = here.where("limited").groupBy("core_a", "core_b").agg(F.lit(True).alias("copied"))
    here = here.join(cut_texts, ["core_a", "core_b"], "left")
    verdict = F.when(F.col("limited"), "field limit").when(F.col("copied"), "copy").when(F.col("ending") == "cut", "transfer")
    return here.select("doc_id", "source_name", verdict.alias("verdict"))


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the documents whose text was cut off, each once."""
    return judged(documents).where("verdict is not null and doc_id is not null").select("doc_id").distinct()


def report(documents: DataFrame) -> DataFrame:
    """How often each source cuts: ``source_name, texts, at_limit, in_transfer, share``;
    copies of texts that were cut at a limit elsewhere count as in transfer."""
    rows = measured(documents)
    texts = rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("texts"))
    cuts = judged(documents, rows).groupBy("source_name").agg(F.count_if(F.col("verdict") == "field limit").alias("at_limit"), F.count_if(F.col("verdict").isin("copy", "transfer")).alias("in_transfer"))
    out = texts.join(cuts, "source_name", "left").na.fill(0, ["at_limit", "in_transfer"])
    return out.withColumn("share", F.round((F.col("at_limit") + F.col("in_transfer")) / F.col("texts"), 6))


def lengths(documents: DataFrame) -> DataFrame:
    """``source_name, measure, length, ended, reached, expected``: the hazards of
    the texts as sent (in characters and bytes)."""
    h = hazards(measured(documents)).where("measure in ('chars', 'bytes')")
    return h.select("source_name", "measure", F.col("length").cast("bigint").alias("length"), "ended", "reached", F.round("expected", 6).alias("expected"))
