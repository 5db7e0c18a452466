r"""Personal data replaced by surrogates, in DataFrame functions only.

Emails, phone, card, social-security and account numbers, IPv4 addresses and
names after a form of address are found by one pattern.  Each distinct
entity (coreference: the same value in any notation or case, and a surname
or given name by itself) gets one keyed surrogate in the whole table:

* numbers keep their length, grouping, country code and the rightness of their check digits (card: Luhn,
  account: remainder by 97), names their script, gender and case, addresses their shape;
* numbers and addresses are mapped by a keyed permutation of the values of their form, so different ones
  stay different however full the form is (a value may be mapped to another number that
  occurs in the table, which is replaced as well);
* collision check of names and mail addresses: a surrogate that two entities share, or that is itself an
  entity of the table, is drawn again by all but the first of them, until
  none is left (they grow from the fourth draw on).

Entities travel as rows of distinct values, texts only to join their
replacements.  Cases: a null text stays null; a text without entity stays as
it is; a hot entity is one row of the table and its occurrences are a join that
adaptive execution splits; rows repeated in identifier and text get equal texts;
extra columns stay; an empty table gives an empty result; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlelake.llm.common import stored

# Forms of address by gender, and the patterns of the entities.
FEMALE = r"Mrs|Ms|Miss|Mme|Madame|Mlle|Frau|Sra|Se\x{00F1}ora|Signora|\x{0413}\x{043E}\x{0441}\x{043F}\x{043E}\x{0436}\x{0430}|\x{039A}\x{03C5}\x{03C1}\x{03AF}\x{03B1}"
MALE = r"Mr|Monsieur|Herr|Sr|Se\x{00F1}or|Signor|\x{0413}\x{043E}\x{0441}\x{043F}\x{043E}\x{0434}\x{0438}\x{043D}|\x{039A}\x{03CD}\x{03C1}\x{03B9}\x{03BF}\x{03C2}"
EITHER = r"Dr|Prof|Professor|Doctor"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9-])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{FEMALE}|{MALE}|{EITHER})\.? \p{{Lu}}[\p{{Ll}}\p{{Lu}}'\x{{2019}}-]+(?: \p{{Lu}}[\p{{Ll}}\p{{Lu}}'\x{{2019}}-]+)?",
}
#: A phone number's type ends with the digits of its country code, which stay.
PHONES = ("phone0", "phone1", "phone2", "phone3")
NUMBERS = ("ssn", "card", "iban", *PHONES)
# Country codes of one and of two digits; all others have three.
ONE_DIGIT = "[17]"
TWO_DIGITS = "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ROUNDS = 6
# Syllables of surrogate names by script, and the endings by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ka ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te va ve".split(),
    "cyrillic": "ба бе би бо да де ди до ва ве га го жа за ка ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се та те фа хо".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε γι γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε φα φε".split(),
}
ENDINGS = {
    "latin": {"f": "lia", "m": "ron", "n": "sun", "s": "stan"},
    "cyrillic": {"f": "лия", "m": "рон", "n": "сен", "s": "стан"},
    "greek": {"f": "λια", "m": "ρος", "n": "σιν", "s": "στας"},
}
DRAWS = 12


def any_entity() -> str:
    """All patterns as one; the groups that back references name are counted on."""
    out, groups = [], 0
    for p in PATTERNS.values():
        own = p.count("([ -]?)")
        for i in range(own, 0, -1):
            p = p.replace(f"\\{i}", f"\\{i + groups}")
        groups += own
        out.append(p)
    return "|".join(f"(?:{p})" for p in out)


#: What every entity holds; spares other texts the long pattern.
HINT = rf"@|[0-9]{{2,}}|[0-9]\.[0-9]|(?:{FEMALE}|{MALE}|{EITHER})\.? \p{{Lu}}"


def kind_of(entity: Column) -> Column:
    """Name of the pattern that the whole entity matches, in their order."""
    bare = {"phone": r"\+?[0-9(][0-9 .()-]+"}
    out = F.when(entity.contains("@"), "email")
    for name in ("iban", "ip", "ssn", "card", "phone"):
        out = out.when(entity.rlike(f"^(?:{bare.get(name, PATTERNS[name])})$"), name)
    return out.otherwise("name")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def units(entity: Column, kind: Column) -> Column:
    """An entity as parts that are replaced each for itself: ``type`` (null: stays), ``norm``, ``raw``."""
    words = F.split(entity, " ")
    title = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    gender = F.when(title.rlike(f"^(?:{FEMALE})$"), "f").when(title.rlike(f"^(?:{MALE})$"), "m").otherwise("n")
    part = lambda t, w: F.struct(t.alias("type"), F.lower(w).alias("norm"), w.alias("raw"))
    none = F.struct(F.lit(None).cast("string").alias("type"), F.get(words, F.lit(0)).alias("norm"), F.get(words, F.lit(0)).alias("raw"))
    given = lambda w: part(F.concat(F.lit("given_"), gender, F.lit("_"), script_of(w)), w)
    family = lambda w: part(F.concat(F.lit("family_s_"), script_of(w)), w)
    one, two = F.get(words, F.lit(1)), F.get(words, F.lit(2))
    code = F.regexp_replace(entity, "[^0-9]", "")
    country = F.when(~entity.startswith("+"), "phone0").when(code.rlike(f"^{ONE_DIGIT}"), "phone1").when(code.rlike(f"^(?:{TWO_DIGITS})"), "phone2").otherwise("phone3")
    kind = F.when(kind == "phone", country).otherwise(kind)
    whole = F.struct(kind.alias("type"), F.when(kind == "email", F.lower(entity)).when(kind == "iban", F.upper(F.replace(entity, F.lit(" "), F.lit("")))).when(
        kind.isin(*NUMBERS), F.regexp_replace(entity, "[^0-9]", "")).otherwise(entity).alias("norm"), entity.alias("raw"))
    # numbers of one type but different length or prefix are different norms already
    return F.when(kind != "name", F.array(whole)).when(F.size(words) > 2, F.array(none, given(one), family(two))).otherwise(F.array(none, family(one)))


def permuted(values: Column, radix: Column, key: str, label: Column) -> Column:
    """A keyed permutation of all arrays of one size whose entries are below ``radix``: a Feistel network, each
    half in turn shifted, entry by entry, by a hash of the other."""
    half = F.floor(F.size(values) / 2).cast("int")
    left, right = lambda x: F.slice(x, F.lit(1), half), lambda x: F.slice(x, half + 1, F.size(values) - half)

    def shifted(own: Column, other: Column, most: Column, r: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), label, r.cast("string"), F.array_join(other.cast("array<string>"), ".")), 256)
        by = lambda i: F.conv(F.substr(seed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.transform(own, lambda v, i: F.pmod(v + by(i), F.get(most, i)))

    def step(acc: Column, r: Column) -> Column:
        a, b = acc["a"], acc["b"]
        return F.struct(F.when(r % 2 == 0, shifted(a, b, left(radix), r)).otherwise(a).alias("a"), F.when(r % 2 == 1, shifted(b, a, right(radix), r)).otherwise(b).alias("b"))

    start = F.struct(left(values).alias("a"), right(values).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def same_classes(text: Column, key: str, label: Column) -> Column:
    """A permutation of the texts of digits and capitals that have them at the same places."""
    chars = F.split(text, "")
    digit = lambda c: F.regexp_like(c, F.lit("[0-9]"))
    values = F.transform(chars, lambda c: F.when(digit(c), c.cast("string").try_cast("int")).otherwise(F.ascii(c) - 65))
    out = permuted(values, F.transform(chars, lambda c: F.when(digit(c), 10).otherwise(26)), key, F.concat_ws("|", label, F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[A-Z]", "A")))
    return F.array_join(F.zip_with(out, chars, lambda v, c: F.when(digit(c), v.cast("string")).otherwise(F.char(v + 65))), "")


def luhn(digits: Column) -> Column:
    """Check digit that follows the digits."""
    doubled = F.transform(F.reverse(F.split(digits, "")), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)), F.lit(10))


def account_check(country: Column, body: Column) -> Column:
    """The two check digits of an account number."""
    value = lambda c: F.when(F.regexp_like(c, F.lit("[0-9]")), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return 98 - rest


def mapped(key: str, kind: Column, norm: Column) -> Column:
    """Normalised surrogate of a number or address: a permutation of its form's values."""
    rest = lambda at: F.substr(norm, F.lit(at), F.length(norm))
    octets = F.split(norm, "\\.").cast("array<int>")
    address = F.array_join(permuted(octets, F.transform(octets, lambda _: F.lit(256)), key, kind).cast("array<string>"), ".")
    kept = F.substr(kind, F.lit(6), F.lit(1)).try_cast("int")
    phone = F.concat(F.substr(norm, F.lit(1), kept), same_classes(F.substr(norm, kept + 1, F.length(norm)), key, F.concat(kind, F.substr(norm, F.lit(1), kept))))
    # a check digit is as far from the right one as it was: right ones stay right, and nothing is lost
    size = F.length(norm)
    front = F.substr(norm, F.lit(1), size - 1)
    new = same_classes(front, key, kind)
    card = F.concat(new, F.pmod(luhn(new) + F.substr(norm, size, F.lit(1)).try_cast("int") - luhn(front), F.lit(10)).cast("string"))
    country, body = F.substr(norm, F.lit(1), F.lit(2)), rest(5)
    own = same_classes(body, key, F.concat(kind, country))
    check = F.pmod(account_check(country, own) + F.substr(norm, F.lit(3), F.lit(2)).try_cast("int") - account_check(country, body), F.lit(100))
    account = F.concat(country, F.lpad(check.cast("string"), 2, "0"), own)
    return F.when(kind == "ip", address).when(kind == "ssn", same_classes(norm, key, kind)).when(kind.startswith("phone"), phone).when(kind == "card", card).when(kind == "iban", account)


def surrogate(key: str, kind: Column, norm: Column, draw: Column) -> Column:
    """Normalised surrogate of a name or mail address, of one draw: letters and choices from a keyed hash."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, draw.cast("string")), 256)
    digits = F.translate(seed, "abcdef", "012345")
    more = F.greatest(draw - 2, F.lit(0))

    def name(script: str) -> Column:
        table = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        body = F.array_join(F.transform(F.sequence(F.lit(0), more + 1), lambda i: F.get(table, F.conv(F.substr(seed, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % len(SYLLABLES[script]))), "")
        end = F.when(kind.contains("_f_"), ENDINGS[script]["f"]).when(kind.contains("_m_"), ENDINGS[script]["m"]).when(kind.contains("_n_"), ENDINGS[script]["n"]).otherwise(ENDINGS[script]["s"])
        return F.concat(body, end)

    user = F.concat(F.translate(F.substr(seed, F.lit(1), F.lit(7) + more), "0123456789", "ghijklmnop"), F.lit("."), F.substr(digits, F.lit(20), F.lit(2)))
    host = F.concat(F.translate(F.substr(seed, F.lit(30), F.lit(4)), "0123456789", "ghijklmnop"), F.lit(".example."), F.regexp_extract(norm, r"\.([a-z]+)$", 1))
    out = F.when(kind == "email", F.concat(user, F.lit("@"), host))
    for script in SYLLABLES:
        out = out.when(kind.endswith(script), name(script))
    return out


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``type, norm, sur`` for the distinct ``type, norm`` given: no surrogate twice in a type, and no name or mail address that is an entity of it."""
    family = F.regexp_replace("type", "_[fmn]_", "_")
    numbers = F.col("type").isin("ip", *NUMBERS)
    done = entities.filter(numbers).select("type", "norm", F.lit("").alias("group"), mapped(key, F.col("type"), F.col("norm")).alias("sur"))
    entities = entities.filter(~numbers)
    todo = entities
    taken = entities.select(family.alias("group"), F.col("norm").alias("sur"))
    for draw in range(DRAWS):
        now = todo.select("type", "norm", family.alias("group"), surrogate(key, F.col("type"), F.col("norm"), F.lit(draw)).alias("sur"))
        first = now.groupBy("group", "sur").agg(F.min(F.struct("type", "norm")).alias("own")).join(taken, ["group", "sur"], "left_anti")
        won = stored(first.select("own.type", "own.norm", "group", "sur"), "surrogates")
        done = done.unionByName(won)
        taken = taken.unionByName(won.select("group", "sur"))
        left = todo.join(won.select("type", "norm"), ["type", "norm"], "left_anti")
        if left.isEmpty():
            return done.select("type", "norm", "sur")
        todo = stored(left, "again")
    raise ValueError(f"names without a surrogate of their own after {DRAWS} draws: a form has too few values")


def dressed(raw: Column, kind: Column, sur: Column) -> Column:
    """The surrogate in the notation of this occurrence: its separators and its case."""
    slots = F.when(kind == "iban", "[A-Za-z0-9]").otherwise("[0-9]")
    filled = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(
        F.regexp_like(c, slots), F.substr(sur, F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), F.when(kind == "iban", F.lit("[^A-Za-z0-9]")).otherwise(F.lit("[^0-9]")), F.lit(""))), F.lit(1))).otherwise(c)), "")
    upper = (raw == F.upper(raw)) & (F.length(raw) > 1)
    return F.when(kind.isNull(), raw).when(kind.isin(*NUMBERS), filled).when(kind == "ip", sur).when(upper, F.upper(sur)).when(kind == "email", sur).otherwise(F.initcap(sur))


def replace_entities(docs: DataFrame, key: str = "titlelake") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities`` as a last column (in place of one of that name).  ``n_chars`` follows the text where there is one."""
    pattern, names = F.lit(any_entity()), [c for c in docs.columns if c != "n_entities"]
    ids = (F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    hinted = docs.select(ids[0].alias("k1"), ids[1].alias("k2"), "text").filter(F.col("text").rlike(HINT))
    held = hinted.select("k1", "k2", F.regexp_extract_all("text", pattern, F.lit(0)).alias("es")).filter(F.size("es") > 0)
    # rows repeated in identifier and text hold the same entities
    held = stored(held.groupBy("k1", "k2").agg(F.first("es").alias("es")), "entities")
    each = held.select("k1", "k2", F.posexplode("es").alias("pos", "e"))
    parts = each.select("k1", "k2", "pos", F.posexplode(units(F.col("e"), kind_of(F.col("e")))).alias("part", "u")).select("k1", "k2", "pos", "part", "u.*")
    mapping = assign(stored(parts.filter("type is not null").select("type", "norm").distinct(), "distinct"), key)
    new = parts.join(mapping, ["type", "norm"], "left").select("k1", "k2", "pos", "part", dressed(F.col("raw"), F.col("type"), F.col("sur")).alias("s"))
    by_entity = new.groupBy("k1", "k2", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]), " ").alias("s"))
    by_text = by_entity.groupBy("k1", "k2").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("__new"))
    by_text = by_text.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__new")
    own = docs.withColumn("__a", ids[0]).withColumn("__b", ids[1]).join(by_text, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    between = F.split(F.col("text"), any_entity(), -1)
    filled = F.array_join(F.zip_with(between, F.concat("__new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    own = own.withColumn("text", F.when(F.col("__new").isNull(), F.col("text")).otherwise(filled))
    if "n_chars" in names:
        own = own.withColumn("n_chars", F.when(F.col("__new").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return own.select(*names, F.coalesce(F.size("__new"), F.lit(0)).cast("long").alias("n_entities"))
