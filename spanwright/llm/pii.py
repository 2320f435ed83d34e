"""PII surrogates: keyed, type-consistent replacements with collision checks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_names, stage, table

#: Kinds of entity and their patterns, the first that fits wins.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+\-]{1,64}@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){1,8}",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"\b(?i:password|passwd|pwd|token|secret|api_?key)(?:\s{0,3}[=:]\s{0,3})[\"']?[A-Za-z0-9+/_\-]{8,128}[\"']?",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d\-])(?:\d{4}[ \-]?){3}\d{1,7}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{2,5}[ /]\d{5,8})(?![\w])",
    "name": r"\b(?:Mrs?|Ms|Miss|Herr|Frau|Señora?|Sra?|Mme|Madame|Monsieur)\.? \p{Lu}[\p{Ll}'’\-]+(?: \p{Lu}[\p{Ll}'’\-]+)?|(?<!\p{L})(?:г-н|г-жа|господин|госпожа) \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without a match of this has no entity; it is far quicker than the patterns.
HINT = r"[@\d=:]|AKIA|ASIA|Mr|Ms|Mme|Miss|Herr|Frau|Señor|Sra?\.? |Madame|Monsieur|г-|господин|госпожа"
#: Titles of women; every other title of a name is a man's.
WOMEN = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Mme|Madame|г-жа|госпожа)(?=[ .])"
#: Surrogate first names by script and gender.
NAMES = {
    ("latin", "f"): ["Anna", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "Carlo", "Daniel", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"],
}
#: Syllables of which surrogate family names are put together, by script; Cyrillic ones end in -ов, for women in -ова.
SYLLABLES = {
    "latin": ["ba", "bel", "ca", "cor", "da", "del", "fa", "fer", "ga", "gor", "la", "lin", "ma", "mor", "na", "ner"],
    "cyrillic": ["ба", "бел", "ва", "вол", "га", "гор", "да", "дор", "ка", "кор", "ла", "лин", "ма", "мор", "на", "нов"],
}
#: The key where none is given and the session's setting KEY_SETTING is unset: not secret, for tests. Give a secret one.
KEY, KEY_SETTING = "spanwright", "spanwright.pii.key"
#: Attempts that keep the length of a number or key; each one after adds a digit, up to LONGER of them.
ALIKE = 8
LONGER = 8


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern fits the whole entity."""
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def family(entity: Column) -> Column:
    """The family name of a titled name, in lower case, without the ending of a woman's Cyrillic name."""
    last = F.lower(F.regexp_extract(entity, r"(\S+)$", 1))
    return F.when(entity.rlike(WOMEN) & entity.rlike(r"\p{IsCyrillic}"), F.regexp_replace(last, "(?<=[вн])а$", "")).otherwise(last)


def canonical(entity: Column, kind: Column) -> Column:
    """What makes two mentions the same entity: e-mail addresses without case, names without title, numbers by their digits."""
    digits = F.regexp_replace(entity, r"[^\p{L}\p{N}+]", "")
    first = F.lower(F.regexp_extract(entity, r"^\S+ (\S+ )\S+$", 1))
    return F.when(kind == "email", F.lower(entity)).when(kind == "name", F.concat(first, family(entity))).when(kind.isin("phone", "card", "iban", "ssn"), digits).otherwise(entity)


def digit_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def with_luhn_digit(number: Column) -> Column:
    """The number with its last digit set so that Luhn's sum ends in 0."""
    body = F.regexp_replace(F.substr(number, F.lit(1), F.length(number) - 1), r"\D", "")
    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), F.pmod(-digit_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def with_iban_digits(iban: Column) -> Column:
    """The account number with its third and fourth character set so that it is 1 modulo 97."""
    bare = F.concat(F.regexp_replace(F.substr(iban, F.lit(5)), " ", ""), F.substr(iban, F.lit(1), F.lit(2)), F.lit("00"))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(bare, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(F.substr(iban, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(iban, F.lit(5)))


def _stream(kind: Column, same: Column, attempt: Column, key: str) -> Column:
    """96 hexadecimal digits or more from the key and the entity."""
    part = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, same, attempt.cast("string"), F.lit(str(k))), 256) for k in range(2)]
    return F.concat(*part)


def _number(stream: Column, at: int | Column, digits: int = 4) -> Column:
    return F.conv(F.substr(stream, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("int")


def _reshaped(entity: Column, stream: Column, keep: Column, hexadecimal: bool = True) -> Column:
    """Each digit and letter after the first `keep` characters gives way to one of its class: format and length stay."""

    def one(c: Column, i: Column) -> Column:
        # by its place among letters and digits, so that formats of one number stay formats of one number
        at = F.length(F.regexp_replace(F.substr(entity, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(i < keep, c).otherwise(_let(_number(stream, at % 120 + 1), lambda x: swapped(c, x)))

    def swapped(c: Column, x: Column) -> Column:
        other = F.when(c.rlike(r"^[0-9]$"), (x % 10).cast("string"))
        if hexadecimal:  # hexadecimal secrets stay hexadecimal
            other = other.when(c.rlike("^[a-f]$"), F.substr(F.lit("abcdef"), x % 6 + 1, F.lit(1)))
        other = other.when(c.rlike("^[a-z]$"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), x % 26 + 1, F.lit(1)))
        other = other.when(c.rlike("^[A-Z]$"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x % 26 + 1, F.lit(1)))
        return F.coalesce(other, c)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _pick(stream: Column, at: int | Column, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), _number(stream, at) % len(words) + 1)


def surrogate(entity: Column, kind: Column, same: Column, attempt: Column, key: str = KEY, family_attempt: Column | None = None) -> Column:
    """The replacement at some attempt. It depends on the key and the canonical form, so mentions stay coreferent, and
    keeps the kind, script, gender and format of the mention. A family name depends on itself alone, so a person named with
    and without the first name is one. Later attempts draw from larger spaces: names grow by a syllable each; after
    ALIKE attempts numbers and keys grow by a digit each, as short formats can run out. Account numbers get their check
    digits, and card numbers that had a right one too."""
    whole = _let(_stream(kind, same, attempt, key), lambda s: _made(entity, kind, s, attempt))
    last = F.lit(0) if family_attempt is None else family_attempt
    names = F.concat(F.regexp_extract(entity, r"^\S+ ", 0), F.when(entity.rlike(r"^\S+ \S+ \S"), F.concat(first_name(entity, same, attempt, key), F.lit(" "))).otherwise(""), family_name(entity, last, key))
    return F.when(kind == "name", names).otherwise(whole)


def _by_script(entity: Column, of) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _grown(s: Column, attempt: Column, script: str) -> Column:
    """A syllable for each attempt after the first."""
    added = F.transform(F.sequence(F.lit(1), F.least(attempt, F.lit(16))), lambda k: _pick(s, 17 + 4 * k, SYLLABLES[script]))
    return F.when(attempt > 0, F.array_join(added, "")).otherwise("")


def first_name(entity: Column, same: Column, attempt: Column, key: str) -> Column:
    woman = entity.rlike(WOMEN)

    def of(script: str) -> Column:
        return _let(_stream(F.lit("first"), same, attempt, key), lambda s: F.concat(F.when(woman, _pick(s, 1, NAMES[script, "f"])).otherwise(_pick(s, 1, NAMES[script, "m"])), _grown(s, attempt, script)))

    return _by_script(entity, of)


def family_name(entity: Column, attempt: Column, key: str) -> Column:
    def of(script: str) -> Column:
        ending = F.when(entity.rlike(WOMEN), "ова").otherwise("ов") if script == "cyrillic" else F.lit("")
        return _let(_stream(F.lit("family"), family(entity), attempt, key), lambda s: F.concat(F.initcap(F.concat(*(_pick(s, k, SYLLABLES[script]) for k in (5, 9, 13, 17)), _grown(s, attempt, script))), ending))

    return _by_script(entity, of)


def _made(entity: Column, kind: Column, s: Column, attempt: Column) -> Column:
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.least(attempt - ALIKE + 1, F.lit(LONGER))), lambda k: (_number(s, 93 + 4 * k) % 10).cast("string")), "")
    more = F.when(attempt < ALIKE, "").otherwise(more)
    box = F.regexp_extract(entity, "^([^@]*)", 1)
    email = F.concat(_reshaped(box, s, F.lit(0), False), more, F.lit("@mail"), (_number(s, 20) % 10).cast("string"), F.lit(".example.org"))
    # addresses of private use, and numbers that are never given out
    net = F.when(attempt < ALIKE, "10").otherwise((240 + _number(s, 13) % 16).cast("string"))
    ip = F.concat_ws(".", net, *((_number(s, k) % 256).cast("string") for k in (1, 5, 9)))
    prefix = F.length(F.regexp_extract(entity, r"^(\D*[=:]\s*[\"']?|AKIA|ASIA|[A-Z]{2}(?=\d{2})|\+\d{1,3}(?=[ .\-(]))", 1))
    # before a closing quote
    longer = lambda x: F.concat(F.regexp_extract(x, r"^(.*?)([\"']?)$", 1), more, F.regexp_extract(x, r"^(.*?)([\"']?)$", 2))
    shaped = _let(_reshaped(entity, s, prefix), longer)
    right = (kind == "card") & (digit_sum(F.regexp_replace(entity, r"\D", "")) % 10 == 0)
    shaped = F.when(right, _let(shaped, with_luhn_digit)).when(kind == "iban", _let(shaped, with_iban_digits)).otherwise(shaped)
    return F.when(kind == "email", email).when(kind == "ip", ip).otherwise(shaped)


def mentions(text: Column) -> Column:
    """Array of struct(entity, kind, same), in the order of the text."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    typed = F.transform(found, lambda e: F.struct(e.alias("entity"), kind_of(e).alias("kind")))
    return F.transform(typed, lambda e: F.struct(e["entity"].alias("entity"), e["kind"].alias("kind"), canonical(e["entity"], e["kind"]).alias("same")))


def entities(found: DataFrame) -> DataFrame:
    """(m: one mention) -> distinct (kind, same, entity): what surrogates are made for. A name is its family name and, if it
    has one, its first name with it."""
    own = found.select("m.*").distinct()
    names = own.filter("kind = 'name'")
    first = names.filter(F.col("entity").rlike(r"^\S+ \S+ \S")).withColumn("kind", F.lit("first"))
    last = names.withColumn("kind", F.lit("family")).withColumn("same", family(F.col("entity")))
    return own.filter("kind <> 'name'").unionByName(first).unionByName(last).select("kind", "same", "entity").distinct()


def collisions(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, same, attempt) of the entities whose first surrogate won't do; all others have attempt 0.

    A surrogate won't do if another entity has the same (the lowest canonical form keeps it; for first names, another of
    the same family) or if it is an entity of the corpus itself. Those are tried anew until none is left, in a space
    that grows with the attempt (of IP addresses, to 2^28 at most); only they, few by the size of the surrogates' space, are shuffled again."""
    real = stage(found.select("kind", "same").distinct(), "real")
    entity, kind, same, attempt = (F.col(c) for c in ("entity", "kind", "same", "attempt"))
    of_name = F.when(kind == "family", F.regexp_replace(F.lower(family_name(entity, attempt, key)), "(?<=ов)а$", "")).when(kind == "first", F.concat(F.lower(first_name(entity, same, attempt, key)), F.lit(" "), family(entity)))
    made_as = F.coalesce(of_name, canonical(surrogate(entity, kind, same, attempt, key), kind))
    open_, taken, out = found.withColumn("attempt", F.lit(0)), None, None
    while True:
        made = stage(open_.select("entity", "kind", "same", "attempt", made_as.alias("made")), "made")
        owner = made.groupBy("kind", "made").agg(F.min("same").alias("owner"))
        if taken is not None:
            owner = owner.join(taken.select("kind", "made", F.lit(True).alias("old")), ["kind", "made"], "left")
        else:
            owner = owner.withColumn("old", F.lit(None).cast("boolean"))
        owner = owner.join(real.select("kind", F.col("same").alias("made"), F.lit(True).alias("real")), ["kind", "made"], "left")
        owner = stage(owner, "owner")
        judged = made.join(owner, ["kind", "made"]).withColumn("bad", F.coalesce("old", "real", F.col("same") != F.col("owner")))
        # a mention that won't do takes the other mentions of its entity along
        bad = stage(judged.groupBy("kind", "same").agg(F.bool_or("bad").alias("bad")).filter("bad").drop("bad"), "bad")
        if bad.isEmpty():
            break
        taken = owner.select("kind", "made") if taken is None else taken.select("kind", "made").unionByName(owner.select("kind", "made"))
        open_ = stage(open_.join(bad, ["kind", "same"], "left_semi").withColumn("attempt", F.col("attempt") + 1), "open")
        retried = open_.select("kind", "same", "attempt").distinct()
        out = retried if out is None else out.unionByName(retried)
    empty = found.select("kind", "same", F.lit(0).alias("attempt")).limit(0)
    return (empty if out is None else out).groupBy("kind", "same").agg(F.max("attempt").alias("attempt"))


def replace(docs: DataFrame, key: str | None = None, count: str = "n_entities") -> DataFrame:
    """docs with `text` rewritten and `count` added (long, last column; a name that docs doesn't have); other columns and rows stay.

    Two passes over the texts: the mentions of all documents are staged with a hash of their text, their distinct
    entities checked for collisions; then each document is split at its entities and joined again with their
    surrogates. Collided entities reach the documents that mention them as a small map by text hash. The key is the
    argument, or the session's KEY_SETTING. A null text stays null with 0 entities; empty texts stay; very long texts
    are rewritten whole; an empty table stays empty; equal texts and repeated rows get equal results; no column name clashes."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    held, tries, hashed = new_names(docs, "_mentions", "_tries", "_text")
    found = stage(docs.select(F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(mentions(docs["text"]))).alias("m")).distinct(), "mentions")
    again = stage(collisions(stage(entities(found), "entities"), key), "collided")
    work = docs.withColumn(held, F.when(F.col("text").isNotNull(), mentions(F.col("text"))))
    if again.isEmpty():
        work = work.withColumn(tries, F.lit(None).cast("map<string,int>"))
    else:
        names = F.col("m.kind") == "name"
        wanted = F.when(names, F.array(F.struct(F.lit("first").alias("kind"), F.col("m.same").alias("same")), F.struct(F.lit("family").alias("kind"), family(F.col("m.entity")).alias("same")))).otherwise(F.array(F.struct("m.kind", "m.same")))
        own = found.select("text_hash", F.explode(wanted).alias("w")).select("text_hash", "w.*").distinct().join(again, ["kind", "same"])
        own = own.groupBy(F.col("text_hash").alias(hashed)).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "same"), "attempt"))).alias(tries))
        work = work.withColumn(hashed, F.xxhash64("text")).join(stage(own, "tries"), hashed, "left")

    def tried(kind: Column, same: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(tries), F.concat_ws("\x1f", kind, same)), F.lit(0))

    def new(m: Column) -> Column:
        own = tried(F.when(m["kind"] == "name", "first").otherwise(m["kind"]), m["same"])
        return surrogate(m["entity"], m["kind"], m["same"], own, key, tried(F.lit("family"), family(m["entity"])))

    between = F.split("text", ANY)
    made = F.concat(F.transform(F.col(held), new), F.array(F.lit("")))
    whole = F.array_join(F.transform(F.arrays_zip(between.alias("a"), made.alias("b")), lambda p: F.concat(p["a"], p["b"])), "")
    text = F.when(F.coalesce(F.size(held), F.lit(0)) > 0, whole).otherwise(F.col("text"))
    names = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return work.select(*names, F.coalesce(F.greatest(F.size(held), F.lit(0)), F.lit(0)).cast("long").alias(count))


def surrogate_stage(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The same rows and columns, with surrogates in the texts; nulls, empty and long texts, ties and repeated rows as in replace."""
    (count,) = new_names(docs, "n_entities")
    return replace(docs, key, count).select(*(f"`{c}`" for c in docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, and how many entities gave way."""
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
