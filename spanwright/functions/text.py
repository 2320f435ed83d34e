"""Column functions on text: normalisation, words, references, time stamps, validation."""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that normalisation deletes, and those that it folds.
MARKS = [*range(0x064B, 0x0659), 0x065C, 0x065E, 0x0640, *range(0x06D6, 0x06EE), 0x2009, 0x0670, 0x0621]
FOLDED = {0x0671: 0x0627, 0x0629: 0x0647, 0x0626: 0x064A, 0x0624: 0x0648, 0x0622: 0x0627, 0x0623: 0x0627, 0x0625: 0x0627, 0x0649: 0x064A}
#: Marks and letters of a long vowel. Fixed values.
LONG_VOWEL = "[ٰٓاويىآۥۦ]"
#: Types by file name extension. Fixed values.
MEDIA = {"mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "html": "text/html", "json": "application/json"}

_BLANK = "(?U)^\\s+|\\s+$"


def _folded(text: Column) -> Column:
    drop = [m for m in MARKS if m not in FOLDED]
    return F.translate(text, "".join(map(chr, [*FOLDED, *drop])), "".join(map(chr, FOLDED.values())))


def fold(text: Column) -> Column:
    """Orthographic normalisation: marks go, letter forms fold, white space at the ends goes."""
    return F.regexp_replace(_folded(text), _BLANK, "")


def fold_standard(text: Column) -> Column:
    """The standard-spelling variant: the small alef is written out before folding."""
    return fold(F.replace(F.replace(text, F.lit("وٰة"), F.lit("اة")), F.lit("ٰ"), F.lit("ا")))


def words(text: Column) -> Column:
    """Words between (Unicode) white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def folded_words(text: Column) -> Column:
    """Each word folded; a word has no white space that could go."""
    return F.transform(words(text), _folded)


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^ء-غف-ي]", "")


def word_forms(raw: Column) -> Column:
    """Both spellings, and the two parts of a joined vocative."""
    own = fold(raw)
    vocative = F.when(raw.contains("ٰ") & own.startswith("يا") & (F.length(own) > 3), F.array(F.lit("يا"), F.concat(F.lit("ا"), F.substring(own, 3, 1 << 30))))
    return F.array_distinct(F.concat(F.array(own, fold_standard(raw)), F.coalesce(vocative, F.array().cast("array<string>"))))


def has_long_vowel(raw: Column) -> Column:
    return raw.rlike(LONG_VOWEL)


def ends_clause(word: Column) -> Column:
    bare = F.regexp_replace(word, "[\"'”’)\\]»]+$", "")
    return bare.rlike(r"[.;!?،:,]$") | bare.rlike("^[-–—]+$")


def reference(text: Column, parts: int = 3) -> Column:
    """"s:a:w" -> array of ints; null if it is not one."""
    cut = F.split(text, ":")
    return F.when(text.rlike(r"^\d{1,9}(:\d{1,9}){%d}$" % (parts - 1)), F.transform(cut, lambda x: x.try_cast("int")))


def clock(ms: Column, mark: str = ",") -> Column:
    """Milliseconds as HH:MM:SS,mmm; before zero counts as zero."""
    ms = F.greatest(ms.cast("long"), F.lit(0))
    part = lambda n, size, width: F.lpad((F.floor(ms / n) % size if size else F.floor(ms / n)).cast("string"), width, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def media_type(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def valid_media_id(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9_-]{1,64}\z"), F.lit(False))


def span_or_words(time_from: Column, time_to: Column, starts: Column, ends: Column) -> Column:
    """The reported span if it has length, else the extent of the word times, else null."""
    own = F.struct(time_from.alias("start"), time_to.alias("end"))
    rest = F.when((F.size(starts) > 0) & (F.size(ends) > 0), F.struct(F.array_min(starts).alias("start"), F.array_max(ends).alias("end")))
    return F.when(time_to > time_from, own).otherwise(rest)


def error_class(status: Column) -> Column:
    """HTTP status -> permanent or transient."""
    return F.when(status == 429, "transient").when(status >= 500, "transient").when(status >= 400, "permanent")


def millis(ts: Column) -> Column:
    """A time stamp without zone as milliseconds since 1970, whatever the session's zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit, n: F.extract(F.lit(unit), since).cast("long") * n
    return part("DAY", 86_400_000) + part("HOUR", 3_600_000) + part("MINUTE", 60_000) + F.floor(F.extract(F.lit("SECOND"), since) * 1000).cast("long")


#: Endings of the soundtrack of a video file, as a pattern. Fixed value.
SOUNDTRACK = r"(?i)(\.(?:mp4|webm|mov|avi|mkv|m4v|ogv))\.audio\.ogg$"


def is_soundtrack(name: Column) -> Column:
    """Whether a file name is that of a video's soundtrack; null is none."""
    return F.coalesce(name.rlike(SOUNDTRACK), F.lit(False))


def video_of(name: Column) -> Column:
    """The video's name that a soundtrack's name was made from; any other name stays."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), SOUNDTRACK, "$1")


def within_alphabet(text: Column, alphabet: str) -> Column:
    """Letters of an aligner: marks go, forms fold, a space is |; empty if a letter outside the alphabet is left."""
    marks = "".join(map(chr, [*range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06EE), 0x0640, 0xFDFD]))
    plain = F.translate(F.translate(text, "ةىٱ" + marks, "هيا"), " ", "|")
    return F.when(F.translate(plain, alphabet, "") == "", plain).otherwise("")


def clause_span(own: Column, first: Column, last: Column, ends: Column | None = None) -> Column:
    """struct(first, last): places first..last of the words, last exclusive, widened on either side to the nearest end of a clause.

    ends: `ends_clause` of each word, if it is known; so a text that many spans are of is looked through once."""
    n = F.size(own)
    a = F.greatest(F.lit(0), F.least(first, n - 1))
    b = F.greatest(a + 1, F.least(last, n))
    behind = lambda k: ends_clause(F.get(own, k - 1)) if ends is None else F.get(ends, k - 1)
    opens = F.filter(F.sequence(F.lit(0), a), lambda k: (k == 0) | behind(k))
    closes = F.filter(F.sequence(b, n), lambda k: (k == n) | behind(k))
    return F.when(n > 0, F.struct(F.array_max(opens).alias("first"), F.array_min(closes).alias("last"))).otherwise(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last")))


def trimmed(own: Column, other: Column, first: Column, last: Column, ends: Column | None = None) -> Column:
    """struct(own, other): the words first..last of `own`, and in proportion of its translation `other`, whole clauses (`ends` as in clause_span)."""
    n, m = F.size(own), F.size(other)
    at = lambda k: F.when((m > 0) & (m != n), F.bround(k * m / n).cast("int")).otherwise(k)
    cut = lambda w, a, b: F.array_join(F.slice(w, a + 1, F.greatest(F.lit(0), b - a)), " ")
    part = once(clause_span(other, at(first), at(last), ends), lambda span: cut(other, span["first"], span["last"]))
    return F.struct(cut(own, first, last).alias("own"), F.when(m > 0, part).otherwise("").alias("other"))


def leading_openers(own: Column, openers: dict[str, list[str]]) -> Column:
    """The names of the opening phrases that words begin with, in the given order; each may be absent. Words are compared folded, in either spelling."""
    at, found = F.lit(0), []
    for name, phrase in openers.items():
        wanted = [F.array(fold(F.lit(w)), fold_standard(F.lit(w))) for w in phrase]
        there = F.size(own) >= at + len(phrase)
        for k, forms in enumerate(wanted):
            there = there & F.arrays_overlap(forms, F.array(F.coalesce(fold(F.get(own, at + k)), F.lit("")), F.coalesce(fold_standard(F.get(own, at + k)), F.lit(""))))
        there = F.coalesce(there, F.lit(False))
        found.append(F.when(there, F.lit(name)))
        at = F.when(there, at + len(phrase)).otherwise(at)
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def once(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without_openings(own: Column, leading: dict[str, list[str]], anywhere: list[str]) -> Column:
    """Words without the opening phrases that they begin with, and without a phrase wherever it stands; words, which have no white space, are compared folded."""
    sizes = F.create_map(*(F.lit(x) for name, phrase in leading.items() for x in (name, len(phrase))))
    phrase, n = [fold(F.lit(w)) for w in anywhere], len(anywhere)

    def behind(w: Column) -> Column:
        skip = F.aggregate(leading_openers(w, leading), F.lit(0), lambda a, name: a + F.try_element_at(sizes, name))
        return F.slice(w, skip + 1, F.size(w))

    def stands(folded: Column, i: Column) -> Column:
        # words are compared one by one, that at i first, as it mostly is of no phrase
        here = [reduce(lambda a, b: a & b, (F.coalesce(F.get(folded, i - k + j) == phrase[j], F.lit(False)) for j in sorted(range(n), key=lambda j: j != k))) for k in range(n)]
        return reduce(lambda a, b: a | b, here)

    def strip(w: Column, folded: Column) -> Column:
        return F.filter(w, lambda _, i: ~stands(folded, i))

    return once(once(own, behind), lambda w: once(F.transform(w, _folded), lambda folded: strip(w, folded)))


def json_words(text: Column) -> Column:
    """Array of struct(text, start, end) from the JSON that a speech service gives; what isn't that, or a word without letters or in no order of time, is left out."""
    rows = F.from_json(text, "array<struct<text:string,start:double,end:double>>", {"mode": "PERMISSIVE"})
    return F.filter(F.coalesce(rows, F.array().cast("array<struct<text:string,start:double,end:double>>")), lambda w: F.coalesce((F.trim(w["text"]) != "") & (w["end"] >= w["start"]), F.lit(False)))


def clamped(value: Column, low: float, high: float, default: float) -> Column:
    """value between low and high; what is no number is the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def lists(column: pa.Array) -> list[list | None]:
    """An Arrow column of arrays as lists, made from all items at once, as an object for each item in between takes most of the time."""
    items = column.values
    if pa.types.is_list(items.type):
        own = lists(items)
    elif items.null_count and not pa.types.is_string(items.type):
        own = items.to_pylist()
    else:
        own = items.to_numpy(zero_copy_only=False).tolist()
    out = [own[a:b] for a, b in pairwise(column.offsets.to_pylist())]
    return [x if there else None for x, there in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out
