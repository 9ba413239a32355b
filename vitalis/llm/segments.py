"""A segment index for edit distance, and the deduplication of new batches against all history with it.

A string within `tau` edits of another shares with it at least one of tau + 1 segments, at nearly the same place. The
index stores each string's segments by block, length and number; a probe cuts, for each length within tau, the few
substrings at which a segment could lie, joins them with the index, and verifies the bounded edit distance. Batches are
appended to the index; nothing stored is read again but by the join.

It works on distinct strings: records are joined to the matched strings afterwards, so a string that a third of the
records have is one entry. A History keeps the segments and the details of what was accepted as tables in a folder;
append_batch() reads of it what the index finds for the new batch, and adds the batch. append_batches() replays a whole
log of batches in one plan, in which each batch sees only earlier ones. Defined results: null and empty strings are not
indexed and match nothing; equal strings are at distance 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.llm.components import components
from vitalis.llm.topn import latest
from vitalis.session import bounded_rows, cut, remove, scratch, stored

#: Batches that are worked off one after the other; their numbers go to the driver.
MOST_BATCHES = 10_000
#: Under an identifier with more different details than this, only those are compared that have a blocking key in common.
#: It decides how records are compared, not which.
MOST_PAIRED = 100


def _substrings_at(s: Column, places: Column, length: Column, number: int, size: Column) -> Column:
    cut_out = lambda p: F.struct(length.alias("length"), F.lit(number).alias("number"), F.substring(s, p + 1, size).alias("segment"))
    return F.transform(places, cut_out)


_SEGMENTS = "block string, s string, batch long, length int, number int, segment string"


class SegmentIndex:
    """Distinct strings of several blocks, searchable within tau edits."""

    def __init__(self, tau: int):
        self.tau = tau
        self.parts: list[DataFrame] = []

    def _bounds(self, length: Column) -> list[tuple[Column, Column]]:
        """(start, length) of each segment: the later ones are the longer, by one at most."""
        n = self.tau + 1
        short = F.floor(length / n).cast("int")
        longer = length - short * n  # so many segments, the last, have one character more
        starts, at = [], F.lit(0)
        for k in range(n):
            size = short + F.when(F.lit(k) >= n - longer, 1).otherwise(0)
            starts.append((at, size))
            at = at + size
        return starts

    def segments_of(self, s: Column) -> Column:
        """array of (length, number, segment) of a string."""
        length = F.length(s)
        return F.array(*[F.struct(length.alias("length"), F.lit(k).alias("number"), F.substring(s, at + 1, size).alias("segment")) for k, (at, size) in enumerate(self._bounds(length))])

    def segments(self, strings: DataFrame) -> DataFrame:
        """(block, s, batch, length, number, segment) of each (block, s, batch)."""
        rows = strings.where("s <> ''").select("block", "s", "batch", F.explode(self.segments_of(F.col("s"))).alias("x"))
        return rows.select("block", "s", "batch", "x.length", "x.number", "x.segment")

    def append(self, strings: DataFrame, batch: int = 0) -> None:
        """Adds the distinct (block, s) of a batch; what is in the index already does no harm."""
        self.append_many(strings.select("block", "s").distinct().withColumn("batch", F.lit(batch)))

    def append_many(self, strings: DataFrame) -> None:
        """Adds distinct (block, s, batch) of several batches at once."""
        self.parts.append(cut(self.segments(strings)))

    def save(self, path: str) -> None:
        """Writes the index as a table; load() reads it again, and further batches may be added to its folder."""
        reduce(DataFrame.unionByName, self.parts).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tau: int) -> SegmentIndex:
        """The index of all tables in a folder; nothing is read but by probe()."""
        index = cls(tau)
        index.parts.append(spark.read.schema(_SEGMENTS).parquet(path))
        return index

    def substrings_of(self, s: Column) -> Column:
        """array of (length, number, segment) that strings within tau of a string would have."""
        tau, own = self.tau, F.length(s)
        tries = []
        for more in range(-tau, tau + 1):  # the other string's length less this one's
            length = own + more
            for k, (at, size) in enumerate(self._bounds(length)):
                low = F.greatest(F.lit(0), at - k, at - more - (tau - k))
                high = F.least(own - size, at + k, at - more + (tau - k))
                places = F.when((high >= low) & (length > 0), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
                tries.append(_substrings_at(s, places, length, k, size))
        return F.array_distinct(F.flatten(F.array(*tries)))

    def substrings(self, strings: DataFrame) -> DataFrame:
        """(block, s, ..., length, number, segment) that matching strings of each length would have."""
        rows = strings.where("s <> ''").select("*", F.explode(self.substrings_of(F.col("s"))).alias("x"))
        return rows.select(*strings.columns, "x.length", "x.number", "x.segment")

    def probe(self, strings: DataFrame) -> DataFrame:
        """(block, s, other, distance): indexed strings within tau edits of each distinct (block, s).

        Where the strings have a column batch, only what came with earlier batches is found, and batch stays.
        """
        keys = ["block", "s", *(["batch"] if "batch" in strings.columns else [])]
        tries = self.substrings(strings.select(*keys).distinct()).withColumnsRenamed({"s": "__mine", "batch": "__now"})
        index = reduce(DataFrame.unionByName, self.parts)
        met = tries.join(index, ["block", "length", "number", "segment"])
        if len(keys) == 3:
            met = met.where("batch < __now").select("block", "__mine", "__now", "s").distinct()
        else:
            met = met.select("block", "__mine", "s").distinct()
        distance = F.levenshtein("__mine", "s", self.tau)
        kept = ["block", "__mine", *(["__now"] if len(keys) == 3 else [])]
        found = met.select(*kept, F.col("s").alias("other"), distance.alias("distance")).where("distance >= 0")
        return found.withColumnsRenamed({"__mine": "s", "__now": "batch"})


#: fixed values: words that stand for a missing value
NULL_WORDS = (
    "unknown unk onbekend unbekannt inconnu inconnue desconocido desconocida none null nil nvt na nb nn nnb tba tbd test xxx xx "
    "geen keine aucun ninguno naam name adres adresse address volgt follows vermeld niet not ingevuld gegeven available bekend "
    "leeg empty missing vacant dummy tel telefoon phone no nummer zonder ohne sans sin anoniem anonymous nomen nescio"
).split()
#: those that only qualify other words and alone say nothing either
_WORDS = "|".join(sorted(NULL_WORDS, key=len, reverse=True))


def made_of_null_words(value: Column) -> Column:
    """Whether there is nothing but words that stand for a missing value, and signs."""
    letters = F.regexp_replace(F.lower(value), r"(?<=\b\p{L})[./](?=\p{L}\b)", "")  # n/a, n.v.t.
    return F.regexp_replace(letters, r"[\P{L}]+", " ").rlike(rf"^ ?(?:(?:{_WORDS}) ?)*$") & ~F.lower(value).rlike(r"\d{3}")


def badly_shaped(field: Column, value: Column) -> Column:
    """Whether a value lacks the form that values of its field have."""
    digits = F.regexp_replace(value, r"\D", "")
    one_sign = F.regexp_replace(value, r"[^\p{L}\p{N}]", "").rlike(r"^(.?)\1*$")
    return (
        F.when(field == "name", one_sign | ~value.rlike(r"\p{L}{2}"))
        .when(field == "addr", one_sign | ~value.rlike(r"\p{L}{2}"))
        .when(field == "telecom", (F.length(digits) < 6) & ~value.contains("@") | digits.rlike(r"^(\d)\1*$"))
        .when(field == "birth", value.rlike(r"^1[89]00-01-01|^(?:1[0-7]00|0\d{3}|9999)-|^1111-11-11"))
        .otherwise(F.lit(False))
    )


#: fixed values: titles before names, and letters with their plain forms
_TITLES = r"^(?:(?:mw|mevr|mevrouw|dhr|heer|de heer|meneer|dr|drs|prof|ir|ing|mr|mrs|ms|miss|herr|frau|hr|fr|mme|sr|sra)\b\.? +)+"
_ACCENTS = ("àáâãäåāçčćèéêëēěìíîïīñňòóôõöøōřšśùúûüūýÿžźż", "aaaaaaaccceeeeeeiiiiinnooooooorssuuuuuyyzzz")


def plain_name(name: Column) -> Column:
    """Given name first, without titles, accents and signs; null for fillers."""
    text = F.translate(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), *_ACCENTS)
    text = F.regexp_replace(text, _TITLES, "")
    turned = F.regexp_replace(text, r"^([^,]+), *([^,]+)$", "$2 $1")
    turned = F.regexp_replace(turned, _TITLES, "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(turned, r"[^\p{L}\p{N} -]", ""), " +", " "))
    nothing = made_of_null_words(name) | badly_shaped(F.lit("name"), name)
    return F.when(~nothing & (clean != ""), clean)


def plain_identifiers(ids: Column) -> Column:
    """array<string> of root|extension as they are compared: letters and digits, no leading zeros; fillers are left out."""
    ext = lambda x: F.regexp_replace(F.regexp_replace(F.upper(x["extension"]), r"[^\p{L}\p{N}]", ""), r"^0+", "")
    root = lambda x: F.regexp_replace(F.trim(F.coalesce(x["root"], F.lit(""))), r"^(?i:urn:oid:)", "")
    real = F.filter(F.coalesce(ids, F.array().cast(_IDS)), lambda x: x["extension"].isNotNull() & ext(x).rlike(r"\d") & ~ext(x).rlike(r"^(.)\1*$") & (F.length(ext(x)) > 3))
    return F.array_distinct(F.transform(real, lambda x: F.struct(root(x).alias("block"), ext(x).alias("s"))))


_IDS = "array<struct<root:string,extension:string>>"


def features(records: DataFrame) -> DataFrame:
    """What persons are compared by: one row per record, real values only."""
    name = plain_name(F.col("name"))
    birth = F.date_format("birth_time", "yyyyMMdd")
    addr = F.translate(F.lower("addr"), *_ACCENTS)
    addr = F.trim(F.regexp_replace(F.regexp_replace(addr, r"[^\p{L}\p{N}]+", " "), " +", " "))
    digits = F.regexp_replace("telecom", r"\D", "")
    nothing = lambda field, c: made_of_null_words(F.col(c)) | badly_shaped(F.lit(field), F.col(c))
    born = F.date_format("birth_time", "yyyy-MM-dd")
    gender = F.upper(F.substring(F.trim("gender"), 1, 1))
    rows = records.select(
        F.col("_id").alias("id"),
        F.col("_id_cluster").alias("cluster"),
        plain_identifiers(F.col("id").cast(_IDS)).alias("ids"),
        name.alias("name"),
        F.when(~badly_shaped(F.lit("birth"), born), birth).alias("birth"),
        F.when(gender.isin("F", "M"), gender).alias("gender"),
        F.when(~nothing("addr", "addr") & (addr != ""), addr).alias("addr"),
        F.when(~nothing("telecom", "telecom"), F.substring(digits, -8, 8)).alias("telecom"),
    )
    given = F.substring_index("name", " ", 1)
    family = F.when(F.col("name").contains(" "), F.expr("substring(name, instr(name, ' ') + 1)"))
    whole = F.when(F.col("name").isNotNull() & F.col("birth").isNotNull() & F.col("addr").isNotNull(), F.concat_ws("|", "name", "birth", "addr"))
    return rows.select("*", given.alias("given"), family.alias("family"), whole.alias("whole"))


def near(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b, most) >= 0


def agree(l: str, r: str) -> tuple[Column, Column]:
    """(whether the details of two records don't contradict each other, how many of them agree).

    Names agree up to two edits, with an initial for the given name, or with one part of a double surname. Dates of
    birth agree if they differ by a digit, by swapped day and month, by up to a month, or by a year. Contradicting are
    different names without the same given name and date of birth, and different dates without the same name.
    """
    a, b = (lambda c: F.col(f"{l}.{c}")), (lambda c: F.col(f"{r}.{c}"))
    given = (
        near(a("given"), b("given"), 1)
        | (F.least(F.length(a("given")), F.length(b("given"))) >= 5) & near(a("given"), b("given"), 2)
        | (F.least(F.length(a("given")), F.length(b("given"))) == 1) & (F.substring(a("given"), 1, 1) == F.substring(b("given"), 1, 1))
    )
    parts = lambda c: F.filter(F.split(c, "[ -]"), lambda x: F.length(x) > 3)
    family = near(a("family"), b("family"), 2) | F.arrays_overlap(parts(a("family")), parts(b("family")))
    turned = F.concat_ws(" ", F.array_sort(F.split(a("name"), "[ -]"))) == F.concat_ws(" ", F.array_sort(F.split(b("name"), "[ -]")))
    same_name = F.coalesce(near(a("name"), b("name"), 2), F.lit(False)) | F.coalesce(given & family, F.lit(False)) | F.coalesce(turned, F.lit(False))
    day = lambda c: F.to_date(c, "yyyyMMdd")
    apart = F.abs(F.datediff(day(a("birth")), day(b("birth"))))
    swapped = F.concat(F.substring(a("birth"), 1, 4), F.substring(a("birth"), 7, 2), F.substring(a("birth"), 5, 2)) == b("birth")
    sorted_digits = lambda c: F.array_sort(F.split(c, ""))
    turned_digits = near(a("birth"), b("birth"), 2) & (sorted_digits(a("birth")) == sorted_digits(b("birth")))
    same_birth = F.coalesce((apart <= 31) | apart.isin(365, 366) | near(a("birth"), b("birth"), 1) | swapped | turned_digits, F.lit(False))
    names, births = a("name").isNotNull() & b("name").isNotNull(), a("birth").isNotNull() & b("birth").isNotNull()
    same_given = F.coalesce(given, F.lit(False))
    other_gender = F.coalesce(a("gender") != b("gender"), F.lit(False))
    fits = (
        F.when(names & births, same_name & (same_birth | (a("name") == b("name"))) | same_given & same_birth)
        .when(names, same_name)
        .when(births, same_birth)
        .otherwise(~other_gender)
    )
    count = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    score = 3 * count(same_name) + 3 * count(same_birth) + count(a("gender") == b("gender")) + count(near(a("addr"), b("addr"), 2)) + count(near(a("telecom"), b("telecom"), 1))
    return fits, score


_DETAILS = ["name", "given", "family", "birth", "gender", "addr", "telecom"]


def _keyed(rows: DataFrame) -> DataFrame:
    """rows by each string under which they are found: their identifiers, and their whole details."""
    own = ["id", "batch", *(["person"] if "person" in rows.columns else []), *_DETAILS]
    each = rows.select(*own, F.size("ids").alias("n_ids"), F.explode(F.concat("ids", F.when(F.col("whole").isNotNull(), F.array(F.struct(F.lit("whole").alias("block"), F.col("whole").alias("s")))).otherwise(F.array().cast("array<struct<block:string,s:string>>")))).alias("x"))
    return each.select("x.block", "x.s", "n_ids", *own)


def _same_string(a: str, b: str, *more: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("block", "s", *more)])


def _wide(keyed: DataFrame, folder: str) -> DataFrame | None:
    """(block, s) of the identifiers with more than MOST_PAIRED different details; None if there are none.

    Details are only told apart under identifiers that have so many records in the first place.
    """
    named = keyed.where("block <> 'whole'")
    hot = stored(named.groupBy("block", "s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_PAIRED).select("block", "s"), folder)
    if hot.isEmpty():
        return None
    details = F.count_distinct(F.xxhash64(*_DETAILS))  # equal hashes would only make a string less wide
    found = stored(named.join(hot, ["block", "s"]).groupBy("block", "s").agg(details.alias("n")).where(F.col("n") > MOST_PAIRED).select("block", "s"), folder)
    return None if found.isEmpty() else found


def _profiled(keyed: DataFrame) -> DataFrame:
    """keyed with kind (2 for a name, plus 1 for a date of birth) and what, the details as one string."""
    kind = F.when(F.col("name").isNotNull(), 2).otherwise(0) + F.when(F.col("birth").isNotNull(), 1).otherwise(0)
    return keyed.withColumn("kind", kind).withColumn("what", F.to_json(F.struct(*_DETAILS)))


def _birth_keys(probe: bool) -> Column:
    """array of keys, of which dates of birth that agree() have one in common."""
    birth, text = F.col("birth"), lambda t, *x: F.concat_ws("|", F.lit(t), *x)
    day = F.unix_date(F.to_date(birth, "yyyyMMdd"))
    span = F.floor(day / 32)
    spans, days = ([span - 1, span, span + 1], [day - 366, day - 365, day + 365, day + 366]) if probe else ([span], [day])
    births = [*[text("span", x) for x in spans], *[text("day", x) for x in days], text("digits", F.array_join(F.array_sort(F.split(birth, "")), ""))]
    births += [text("but", F.lit(k), F.substring(birth, 1, k), F.substring(birth, k + 2, 8)) for k in range(8)]
    return F.when(birth.isNotNull(), F.array(*births))


def _blocking(rows: DataFrame, probe: bool) -> DataFrame:
    """rows by (other, key): details that agree() have a key in common, given as other the kind of the indexed one.

    Dates of birth that agree share a span of 32 days or one next to it, all digits but one, the digits in any order, or
    are a year apart. Without two dates, names that agree share a segment of the name or of the family name, a part of
    it, or the words in any order; with two other dates they are equal. Rows whose kinds have nothing in common agree
    without any key; those of them have one whose addresses or telephones are near.
    """
    two, one = SegmentIndex(2), SegmentIndex(1)
    name, family, text = F.col("name"), F.col("family"), lambda t, *x: F.concat_ws("|", F.lit(t), *x)

    def near_keys(t: str, index: SegmentIndex, c: str) -> Column:
        found = index.substrings_of(F.col(c)) if probe else index.segments_of(F.col(c))
        return F.when(F.col(c) != "", F.transform(found, lambda x: text(t, x["length"], x["number"], x["segment"])))

    parts = F.filter(F.split(family, "[ -]"), lambda x: F.length(x) > 3)
    words = F.array(text("words", F.concat_ws(" ", F.array_sort(F.split(name, "[ -]")))))
    groups = [  # keys, and the details in common (as kind) of the pairs they are for
        (_birth_keys(probe), (1, 3)),
        (F.when(name.isNotNull(), F.array(text("name", name))), (3,)),
        (F.when(name.isNotNull(), words), (2,)),
        (F.transform(parts, lambda x: text("part", x)), (2,)),
        (near_keys("near", two, "name"), (2,)),
        (near_keys("family", two, "family"), (2,)),
        (near_keys("addr", two, "addr"), (0,)),
        (near_keys("telecom", one, "telecom"), (0,)),
    ]
    none = F.array().cast("array<string>")
    each = []
    for keys, common in groups:
        others = F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: k.bitwiseAND(F.col("kind")).isin(*common)) if probe else F.array(F.col("kind"))
        each.append(F.struct(F.coalesce(keys, none).alias("keys"), others.alias("others")))
    rows = rows.select("*", F.explode(F.array(*each)).alias("g")).select("*", F.explode("g.others").alias("other"))
    return rows.select("*", F.explode("g.keys").alias("key")).drop("g")


#: genders that a record may ask with, as written in features(); empty: none
_GENDERS = ("", "F", "M")
#: the score by agree(), without address and telephone, of details with neither name nor date of birth in common; where
#: both lack a name, their names count as equal
_UNCOMPARED = "3 * int((kind | kind_b) & 2 = 0) + int(asks = of and of <> '')"


def _one_person(profiles: DataFrame, wide: DataFrame | None, folder: str) -> list[DataFrame]:
    """links (a, b) of records of one batch that state the same person; profiles are _profiled(), wide as in _pairs().

    Records with a name and a date of birth are linked with all such records they agree with. One that lacks a detail
    would agree with contradicting persons, so it is linked with one record only: that with most details (a name is
    more than a date), most agreeing details, the smallest. Where it agrees with none that has more details, it is linked
    with all alike.
    """
    first = profiles.groupBy("batch", "block", "s", "what", "kind", *_DETAILS).agg(F.min("id").alias("id"))
    fits, score = agree("a", "b")
    a = first if wide is None else _blocking(first, probe=True)
    b = first if wide is None else _blocking(first, probe=False)
    on = _same_string("a", "b", "batch")
    if wide is not None:
        on = on & (F.col("a.other") == F.col("b.other")) & (F.col("a.key") == F.col("b.key"))
    met = a.alias("a").join(b.alias("b"), on).where((F.col("b.kind") >= F.col("a.kind")) & fits)
    under = ["batch", "block", "s", "what"]
    pairs = met.select(*[f"a.{c}" for c in (*under, "kind", "id")], F.col("b.kind").alias("kind_b"), F.col("b.id").alias("id_b"), score.alias("score")).distinct()
    if wide is not None:  # those with nothing in common to compare; the best of them is the same for all records of a kind and gender
        asks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(g).alias("asks")) for k in (0, 1) for g in _GENDERS])
        rest = first.select("batch", "block", "s", F.col("kind").alias("kind_b"), F.col("id").alias("id_b"), F.coalesce("gender", F.lit("")).alias("of"), F.explode(asks).alias("x")).select("*", "x.*")
        rest = rest.where("kind & kind_b = 0 and kind_b >= kind and (asks = of or asks = '' or of = '')").withColumn("score", F.expr(f"if(kind_b > kind, {_UNCOMPARED}, 0)"))
        rest = rest.groupBy("batch", "block", "s", "kind", "asks").agg(F.max(F.struct("kind_b", "score", (-F.col("id_b")).alias("least"))).alias("t"))
        asking = first.select(*under, "kind", "id", F.coalesce("gender", F.lit("")).alias("asks"))
        pairs = pairs.unionByName(asking.join(rest, ["batch", "block", "s", "kind", "asks"]).select(*under, "kind", "id", "t.kind_b", (-F.col("t.least")).alias("id_b"), "t.score"))
    pairs = stored(pairs, folder)
    alike = profiles.where("kind = 3").groupBy("batch", "block", "s", "what").agg(F.min("id").alias("b"))
    alike = profiles.where("kind = 3").join(alike, under).select(F.col("id").alias("a"), "b")
    full = pairs.where("kind = 3 and id < id_b").select(F.col("id").alias("a"), F.col("id_b").alias("b"))
    best = F.max(F.struct("kind_b", F.when(F.col("kind_b") > F.col("kind"), F.col("score")).otherwise(0).alias("score"), (-F.col("id_b")).alias("least")))
    most = pairs.where("kind < 3").groupBy(*under).agg(best.alias("t"))
    lacking = stored(profiles.where("kind < 3").join(most, under).groupBy("id", "kind").agg(F.max("t").alias("t")).select("id", "kind", F.col("t.kind_b").alias("kind_b"), (-F.col("t.least")).alias("b")), folder)
    alone = lacking.where("kind = kind_b").select("id")
    free = pairs.where("kind in (1, 2) and kind_b = kind and id <> id_b").join(alone, "id").join(alone.withColumnRenamed("id", "id_b"), "id_b")
    return [alike, full, lacking.select(F.col("id").alias("a"), "b"), free.select(F.col("id").alias("a"), F.col("id_b").alias("b"))]


def _met_wide(mine: DataFrame, keyed: DataFrame) -> DataFrame:
    """_met_before() for records under wide identifiers, by equal identifiers; mine and keyed are _profiled().

    Records that have neither name nor date of birth in common are found here by address and telephone only, with no
    records, as _offered() has all of these.
    """
    profiles = keyed.groupBy("block", "s", "batch", "person", "what", "kind", *_DETAILS).agg(F.count(F.lit(1)).alias("records"))
    under = ["block", "s", "batch", "what"]
    asking = mine.select(*under, "kind", *_DETAILS).distinct()
    fits, score = agree("a", "b")
    on = _same_string("a", "b", "other", "key") & (F.col("b.batch") < F.col("a.batch"))
    met = _blocking(asking, probe=True).alias("a").join(_blocking(profiles, probe=False).alias("b"), on).where(fits)
    records = F.expr("if(a.kind & b.kind = 0, 0, b.records)").alias("records")
    met = met.select(*[f"a.{c}" for c in under], F.col("b.person").alias("person"), F.col("b.batch").alias("before"), F.col("b.what").alias("other"), score.alias("score"), records).distinct()
    met = met.groupBy(*under, "person", "before").agg(F.max("score").alias("score"), F.sum("records").alias("records"))
    return mine.select("id", *under).join(met, under).select("id", "batch", "s", "person", "before", "score", "records")


def _met_near_wide(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """_met_before() for pairs (block, s, batch, other) of identifiers within tau edits of which one is wide.

    SURELY is more than all details but the date of birth come to, so that agrees, and has a key in common.
    """
    full = keyed.where("birth is not null")
    mine = _profiled(full.where("batch > 0").join(pairs.select("block", "s", "batch").distinct(), ["block", "s", "batch"], "left_semi"))
    others = _profiled(full.join(pairs.select("block", F.col("other").alias("s")).distinct(), ["block", "s"], "left_semi"))
    profiles = others.groupBy("block", "s", "batch", "person", "what", *_DETAILS).agg(F.count(F.lit(1)).alias("records"))
    under = ["block", "s", "batch", "what"]
    asking = mine.select(*under, *_DETAILS).distinct().join(pairs, ["block", "s", "batch"])
    a, b = [rows.select("*", F.explode(_birth_keys(probe)).alias("key")) for rows, probe in ((asking, True), (profiles, False))]
    fits, score = agree("a", "b")
    on = (F.col("a.block") == F.col("b.block")) & (F.col("a.other") == F.col("b.s")) & (F.col("a.key") == F.col("b.key")) & (F.col("b.batch") < F.col("a.batch"))
    met = a.alias("a").join(b.alias("b"), on).where(fits & (score >= SURELY))
    met = met.select(*[f"a.{c}" for c in (*under, "other")], F.col("b.person").alias("person"), F.col("b.batch").alias("before"), F.col("b.what").alias("what_b"), score.alias("score"), "b.records").distinct()
    return mine.select("id", *under).join(met, under).select("id", "batch", "s", "person", "before", "score", "records")


def _offered(keyed: DataFrame, wide: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(asking, offers): what agrees under wide identifiers for want of any name or date of birth to compare.

    Every such record of any person does that isn't of another gender, so nobody's pairs are listed: asking (id, batch,
    kind, asks, strings) has for each record its kind, gender and wide identifiers, and offers (block, s, kind, asks,
    person, before, score, records) the persons that all records alike in these meet under one of them.
    """
    hot = _profiled(keyed.join(wide, ["block", "s"])).withColumn("of", F.coalesce("gender", F.lit("")))
    asking = hot.where("batch > 0").groupBy("id", "batch", "kind", F.col("of").alias("asks")).agg(F.array_sort(F.collect_set(F.struct("block", "s"))).alias("strings"))
    profiles = hot.groupBy("block", "s", "batch", "person", F.col("kind").alias("kind_b"), "of").agg(F.count(F.lit(1)).alias("records"))
    asks = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(g).alias("asks")) for k in range(4) for g in _GENDERS])
    each = profiles.select("*", F.explode(asks).alias("x")).select("*", "x.*").where("kind & kind_b = 0 and (asks = of or asks = '' or of = '')")
    offers = each.groupBy("block", "s", "kind", "asks", "person", F.col("batch").alias("before")).agg(F.max(F.expr(_UNCOMPARED)).alias("score"), F.sum("records").alias("records"))
    return stored(asking, folder), stored(offers, folder)


def _persons(rows: DataFrame, wide: DataFrame | None, folder: str) -> DataFrame:
    """(id, person): records of one batch that state the same person have its smallest record as person.

    Under each identifier all different details are compared with each other. Records whose whole details are equal
    belong to one of them, if possible one without identifiers.
    """
    own = scratch(rows.sparkSession, "links")
    keyed = _keyed(rows)
    shared = keyed.groupBy("batch", "block", "s").agg(F.count(F.lit(1)).alias("n"), F.min("n_ids").alias("least"))
    some = shared.where("n > 1 and (block <> 'whole' or least = 0)").select("batch", "block", "s")
    left = stored(_profiled(keyed.join(some, ["batch", "block", "s"])), own)
    whole = left.where("block = 'whole'")
    first = whole.groupBy("batch", "block", "s").agg(F.min_by("id", F.struct("n_ids", "id")).alias("b"))
    links = [whole.join(first, ["batch", "block", "s"]).select(F.col("id").alias("a"), "b")]
    left = left.where("block <> 'whole'")
    if wide is not None:
        links += _one_person(left.join(wide, ["block", "s"]), wide, own)
        left = left.join(wide, ["block", "s"], "left_anti")
    links += _one_person(left, None, own)
    # else the rounds would plan again and again what leads to the links
    each = stored(reduce(DataFrame.unionByName, links), own)
    persons = components(each, rows.select(F.col("id").alias("record_id"))).withColumnsRenamed({"record_id": "id", "group_id": "person"})
    persons = stored(persons, folder)
    remove(rows.sparkSession, own)
    return persons


#: Agreeing details from which an identifier within tau edits counts as mistyped: the name, the date of birth and one more.
SURELY = 7


def _met_before(keyed: DataFrame, tau: int, wide: DataFrame | None, folder: str) -> DataFrame:
    """(id, batch, s, person, before, score, records): what records of a batch agree with that came before it.

    person and before are the earlier records' person and batch; equal details of one person are one profile. Under equal
    identifiers details must not contradict each other; under identifiers that are tau edits apart or less, name, date of
    birth and one more must agree. Whole details must be equal. keyed has a person. Details under wide identifiers meet by
    blocking keys; what agrees there without any is _offered().
    """
    index = SegmentIndex(tau)
    index.parts.append(stored(index.segments(keyed.groupBy("block", "s").agg(F.min("batch").alias("batch"))), folder))
    mine = keyed.where("batch > 0 and (block <> 'whole' or n_ids = 0)")
    pairs = index.probe(mine.select("block", "s", "batch")).where("distance = 0 or block <> 'whole'")
    if wide is not None:
        pairs = stored(pairs, folder)
        hot = stored(_profiled(keyed.join(wide, ["block", "s"])), folder)
        either = wide.select("block", "s", F.lit(True).alias("wide"))
        near = pairs.where("distance > 0").join(either, ["block", "s"], "left").join(either.withColumnsRenamed({"s": "other", "wide": "other_wide"}), ["block", "other"], "left")
        near = stored(near.where("wide or other_wide").select("block", "s", "batch", "other"), folder)
        hot = _met_wide(hot.where("batch > 0"), hot)
        if not near.isEmpty():
            hot = hot.unionByName(_met_near_wide(keyed, near))
        keyed, mine = [rows.join(wide, ["block", "s"], "left_anti") for rows in (keyed, mine)]
    profiles = keyed.groupBy("block", "s", "batch", "person", *_DETAILS).agg(F.count(F.lit(1)).alias("records"))
    fits, score = agree("a", "b")
    whole, equal = F.col("a.block") == "whole", F.col("a.distance") == 0
    same = (F.col("a.block") == F.col("b.block")) & (F.col("a.other") == F.col("b.s"))
    met = mine.join(pairs, ["block", "s", "batch"]).alias("a").join(profiles.alias("b"), same & (F.col("b.batch") < F.col("a.batch")))
    met = met.where(F.when(equal, fits | whole).otherwise(fits & (score >= SURELY)))
    met = met.select("a.id", "a.batch", "a.s", F.col("b.person").alias("person"), F.col("b.batch").alias("before"), score.alias("score"), "b.records")
    return met if wide is None else met.unionByName(hot)


def _in_clusters(rows: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """rows of (person, before) with the cluster that the person was given in that batch; by clusters (person, batch, cluster)."""
    if clusters is None:
        return rows.withColumn("cluster", F.col("person"))
    rows = rows.join(clusters.withColumnsRenamed({"person": "__p", "batch": "__b"}), (F.col("person") == F.col("__p")) & (F.col("before") == F.col("__b")), "left")
    return rows.withColumn("cluster", F.coalesce("cluster", "person"))


def _best(met: DataFrame, folder: str, asking: DataFrame | None = None, offers: DataFrame | None = None) -> DataFrame:
    """(id, b): of the clusters that a record agrees with the one with most agreeing details, identifiers, records, the smallest.

    asking and offers are as from _offered(), with a cluster. What all records that are alike in asking agree with is
    ranked once for all of them; only for clusters in met it is added to what a record meets itself. A cluster that isn't
    in met can't be better than the best of these.
    """
    best = lambda score, shared, records: F.struct(score.alias("score"), shared.cast("long").alias("shared"), records.alias("records"), (-F.col("cluster")).alias("least"))
    if asking is None:
        ranked = met.groupBy("id", "cluster").agg(F.max("score").alias("score"), F.count_distinct("s").alias("shared"), F.sum("records").alias("records"))
        return ranked.groupBy("id").agg(F.max(best(F.col("score"), F.col("shared"), F.col("records"))).alias("b"))
    alike = ["kind", "asks", "strings"]
    each = asking.select(*alike).distinct().select("*", F.explode("strings").alias("x")).select(*alike, "x.*")
    offered = each.join(offers, ["block", "s", "kind", "asks"]).groupBy(*alike, "cluster").agg(F.max("score").alias("score_o"), F.collect_set("s").alias("shared_o"), F.sum("records").alias("records_o"))
    offered = stored(offered, folder)
    most = offered.groupBy(*alike).agg(F.max(best(F.col("score_o"), F.size("shared_o"), F.col("records_o"))).alias("b"))
    ranked = met.groupBy("id", "cluster").agg(F.max("score").alias("score"), F.collect_set("s").alias("shared"), F.sum("records").alias("records"))
    ranked = ranked.join(asking, "id", "left").join(offered, [*alike, "cluster"], "left")
    shared = F.size(F.array_union("shared", F.coalesce("shared_o", F.array().cast("array<string>"))))
    own = ranked.select("id", best(F.greatest("score", "score_o"), shared, F.col("records") + F.coalesce("records_o", F.lit(0))).alias("b"))
    return own.unionByName(asking.join(most, alike).select("id", "b")).groupBy("id").agg(F.max("b").alias("b"))


def _decided(new: DataFrame, best: DataFrame) -> DataFrame:
    """new (id, person, ...) with cluster and known; a person is of one batch."""
    here = new.join(best.select("id", "b"), "id", "left")
    of_person = here.groupBy("person").agg(F.max("b").alias("p"))
    cluster = -F.coalesce("b.least", "p.least", -F.col("person"))
    return here.join(of_person, "person").select(*new.columns, cluster.alias("cluster"), F.col("b").isNotNull().alias("known"))


class History:
    """What was accepted so far, as tables in a folder: the details of records by each of their strings, and the strings'
    segments. Every accepted batch adds a part to both; no part is written again."""

    def __init__(self, spark: SparkSession, path: str, tau: int = 1):
        self.spark, self.path, self.tau = spark, path, tau

    def accept(self, keyed: DataFrame, part: int) -> None:
        """Adds keyed records with their cluster as person. A part that was written before a failure is replaced."""
        keyed = keyed.select(*_KEYED)
        keyed.write.mode("overwrite").parquet(f"{self.path}/keyed/part={part}")
        strings = self.spark.read.schema(keyed.schema).parquet(f"{self.path}/keyed/part={part}").select("block", "s").distinct()
        SegmentIndex(self.tau).segments(strings.withColumn("batch", F.lit(0).cast("long"))).write.mode("overwrite").parquet(f"{self.path}/segments/part={part}")

    def index(self) -> SegmentIndex:
        return SegmentIndex.load(self.spark, f"{self.path}/segments", self.tau)

    def under(self, strings: DataFrame, like: DataFrame) -> DataFrame:
        """The accepted records under some (block, s), as batch 0."""
        stored = self.spark.read.schema(like.schema).parquet(f"{self.path}/keyed")
        return stored.join(strings.distinct(), ["block", "s"], "left_semi").select(*like.columns)


_KEYED = ["block", "s", "n_ids", "id", "batch", "person", *_DETAILS]


def _latest_features(records: DataFrame) -> DataFrame:
    return features(latest(records.where("_id is not null").select("_id", "_id_cluster", "id", "name", "birth_time", "gender", "addr", "telecom", "_lake_timestamp"), "_id"))


def accept_history(records: DataFrame, path: str, tau: int = 1) -> History:
    """A new History of the records that have a cluster."""
    history = History(records.sparkSession, path, tau)
    rows = _latest_features(records).where("cluster is not null").withColumns({"batch": F.lit(0).cast("long"), "person": F.col("cluster")})
    history.accept(_keyed(rows), 0)
    return history


def append_batch(history: History, records: DataFrame, part: int) -> DataFrame:
    """(id, id_cluster, known) of one batch of new records; they are accepted as a part of the history.

    Of the history only the strings that the index finds, and the details under them, take part.
    """
    folder = scratch(history.spark, "batch")
    rows = stored(_latest_features(records).withColumn("batch", F.lit(1).cast("long")), folder)
    own = _keyed(rows.withColumn("person", F.lit(None).cast("long")))
    index = history.index()
    candidates = stored(index.probe(own.select("block", "s")).select("block", F.col("other").alias("s")), folder)
    before = stored(history.under(candidates, own.select(*_KEYED)).withColumn("batch", F.lit(0).cast("long")), folder)
    wide = _wide(before.unionByName(own.select(*_KEYED)), folder)
    persons = _persons(rows, wide, folder)
    named = _keyed(rows.join(persons, "id")).select(*_KEYED)
    every = before.unionByName(named)
    asking, offers = (None, None) if wide is None else _offered(every, wide, folder)
    met = _in_clusters(_met_before(every, history.tau, wide, folder), None)
    new = rows.join(persons, "id").select("id", "batch", "person")
    best = _best(met, folder, asking, None if wide is None else _in_clusters(offers.where("before < 1"), None))
    done = stored(_decided(new, best), scratch(history.spark, "done"))
    accepted = rows.join(done.select("id", F.col("cluster").alias("person")), "id").withColumn("batch", F.lit(0).cast("long"))
    history.accept(_keyed(accepted), part)
    remove(history.spark, folder)
    return done.select("id", F.col("cluster").alias("id_cluster"), "known")


def append_batches(records: DataFrame, log: DataFrame, tau: int = 1) -> DataFrame:
    """(id, id_cluster, batch_no, known): the cluster of every logged record without one, batch by batch.

    records are resolution_a's columns, the latest version of an _id counts; log has (id, batch_no), of which the lowest
    counts. known tells whether the person was accepted before: in a cluster, or in a lower batch. A person first seen
    in a batch has the smallest _id among its records there as cluster. Of several accepted persons that a record agrees
    with, the one with most agreeing details counts, then with most identifiers in common, most records, smallest cluster.
    """
    compared = _latest_features(records)
    when = log.where("id is not null and batch_no is not null").groupBy("id").agg(F.min("batch_no").cast("long").alias("logged"))
    compared = compared.join(when, "id", "left").where("cluster is not null or logged is not null")
    # batches are numbered from 1 in their order; 0 is what was accepted before all of them
    numbers = sorted(r["logged"] for r in bounded_rows(when.select("logged").distinct(), MOST_BATCHES, "batches"))
    place = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(numbers, 1) for x in (n, k)]), F.col("logged")) if numbers else F.lit(0)
    spark = records.sparkSession
    folder, kept = scratch(spark, "batches"), scratch(spark, "decided")
    compared = stored(compared.withColumn("batch", F.when(F.col("cluster").isNotNull(), 0).otherwise(place)), folder)
    new = compared.where("batch > 0")
    wide = _wide(_keyed(compared), folder)
    persons = _persons(new, wide, folder)
    named = compared.join(persons, "id", "left").withColumn("person", F.coalesce("cluster", "person"))
    met = stored(_met_before(_keyed(named), tau, wide, folder), folder)
    asking, offers = (None, None) if wide is None else _offered(_keyed(named), wide, folder)
    new = stored(new.join(persons, "id").select("id", "batch", "person", F.col("logged").alias("batch_no")), kept)
    # the best of each batch is a part of one table, so that no plan grows with the batches before
    best = None
    for k in range(1, len(numbers) + 1):
        clusters = None if best is None else best.groupBy("person", "batch").agg(F.min(-F.col("b.least")).alias("cluster"))  # a person that met none keeps its own
        now = _in_clusters(met.where(F.col("batch") == k), clusters)
        if wide is None:
            found = _best(now, folder)
        else:
            found = _best(now, folder, asking.where(F.col("batch") == k).drop("batch"), _in_clusters(offers.where(F.col("before") < k), clusters))
        found = found.join(new.where(F.col("batch") == k), "id").select("id", "person", "batch", "b")
        found.write.parquet(f"{kept}/best/part={k}")
        best = spark.read.schema(found.schema).parquet(f"{kept}/best").drop("part")
    remove(spark, folder)
    if best is None:
        return new.select("id", F.col("person").alias("id_cluster"), "batch_no", F.lit(True).alias("known")).limit(0)
    return _decided(new, best).select("id", F.col("cluster").alias("id_cluster"), "batch_no", "known")


def near_identifiers(records: DataFrame, tau: int = 1) -> DataFrame:
    """(id, block, s, other, distance): records without a cluster whose identifier is within tau edits of one in a cluster."""
    each = _latest_features(records).select("id", "cluster", F.explode("ids").alias("x")).select("id", "cluster", "x.block", "x.s")
    index = SegmentIndex(tau)
    index.append(each.where("cluster is not null").select("block", "s"))
    mine = each.where("cluster is null").select("id", "block", "s")
    return mine.join(index.probe(mine), ["block", "s"]).select("id", "block", "s", "other", "distance")
