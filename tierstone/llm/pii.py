"""Personal data replaced by surrogates.

Detected entities get replacements drawn by a keyed hash: of the same type, format, script and, for names, gender. The corpus's
distinct entities are checked for collisions, of surrogates with each other and with entities that really occur; those that
collide draw again. So different entities stay different, and one entity is the same wherever it is mentioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm.common import LOWER, UPPER, Scratch, own_columns, table

#: Titles that announce a name, by gender (fixed values).
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Κυρία")
_TITLE = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
_WORD = r"\p{Lu}[\p{L}'’-]*\p{Ll}"
#: Java patterns, by type. A card is 13 to 19 digits, singly parted at most.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.?\x20{_WORD}(?:\x20{_WORD})*",
    "phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Syllables of made-up names by script, and their endings by gender (male, female, neither: surnames).
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti to va ve vi".split(), ("n", "na", "sen")),
    "cyrillic": ("ба бе би бо да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те ти то ва ве ви".split(), ("н", "на", "ко")),
    "greek": ("βα βε βι βο δα δε δι δο γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε τα τε τι το".split(), ("ς", "να", "ου")),
}
#: Words of a gap between mentions, and what stands between them; together they are the whole gap.
_PIECE = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*|[^\p{L}\p{N}]+"
#: Surrogates that may be broadcast; rounds of drawing again.
MOST_BROADCAST, ROUNDS = 200_000, 32


def _kind(m: Column) -> Column:
    return F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{_TITLE})\.?\x20"), "name").when(m.startswith("+") | m.startswith("("), "phone").when(m.rlike(rf"^{PATTERNS['ip']}$"), "ip").otherwise("card")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _keys(mentions: DataFrame) -> DataFrame:
    """Adds kind and the entities that column m names: e1 (address, number or surname) and e2 (an array of given names: all words of a name but the last), as type:value."""
    words = F.split(F.regexp_replace("m", rf"^(?:{_TITLE})\.?\x20", ""), " ")
    gender = F.when(F.regexp_extract("m", rf"^({_TITLE})", 1).isin(list(FEMALE)), "f").otherwise("m")
    kind = _kind(F.col("m"))
    e1 = (
        F.when(F.col("kind") == "email", F.concat(F.lit("email:"), F.translate("m", UPPER, LOWER)))
        .when(F.col("kind") == "name", F.concat(F.lit("surname:"), F.element_at(words, -1)))
        .when(F.col("kind") == "ip", F.concat(F.lit("ip:"), F.col("m")))
        .otherwise(F.concat("kind", F.lit(":"), _digits(F.col("m"))))
    )
    given = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.concat(F.lit("given_"), gender, F.lit(":"), w))
    e2 = F.when(F.col("kind") == "name", given).otherwise(F.array().cast("array<string>"))
    return mentions.withColumn("kind", kind).withColumn("e1", e1).withColumn("e2", e2)


#: SQL: the check sum of a string of digits, 0 if it is right (every second digit from the end counts as the digits of its double).
_LUHN = "pmod(aggregate(sequence(1, length({0})), 0, (a, i) -> a + element_at(array(0,1,2,3,4,5,6,7,8,9,0,2,4,6,8,1,3,5,7,9), int(substring({0}, length({0}) - i + 1, 1)) + if(i % 2 = 0, 10, 0) + 1)), 10)"
#: SQL: an address's local part with other letters for letters and other digits for digits, by the hash h.
_LOCAL = (
    "array_join(transform(split(substring_index(value, '@', 1), ''), (c, i) -> CASE"
    " WHEN c RLIKE '[0-9]' THEN string(pmod(ascii(substring(h, pmod(i, 60) + 1, 1)) * 7 + ascii(substring(h, pmod(i * 5, 60) + 2, 1)), 10))"
    f" WHEN c RLIKE '[a-z]' THEN substring('{LOWER}', pmod(ascii(substring(h, pmod(i, 60) + 1, 1)) * 31 + ascii(substring(h, pmod(i * 7, 60) + 3, 1)) + i, 26) + 1, 1) ELSE c END), '')"
)


def _made_up_name(byte) -> Column:
    """Four syllables and an ending of the entity's script and gender; a fifth and a sixth for those that keep colliding."""
    script = F.when(F.col("value").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("value").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    out = F.lit(None).cast("string")
    for name, (syllables, (male, female, neither)) in SYLLABLES.items():
        from_ = F.split(F.lit(" ".join(syllables)), " ")
        ending = F.when(F.col("type") == "given_m", male).when(F.col("type") == "given_f", female).otherwise(neither)
        one = lambda i: F.element_at(from_, F.pmod(byte(i), F.lit(len(syllables))) + 1)  # noqa: B023, E731
        more = [F.when(F.col("turn") > turn, one(i)).otherwise("") for i, turn in ((4, 2), (5, 6))]
        made = F.concat(*[one(i) for i in range(4)], *more, ending)
        out = F.when(script == name, F.initcap(made)).otherwise(out)
    return out


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entity, turn, surrogate for rows of entity and turn: what a keyed hash of both gives, in the entity's form."""
    h = F.sha2(F.concat_ws("|", F.lit(key), "entity", F.col("turn").cast("string"), F.lit(key)), 256)
    rows = entities.withColumn("type", F.substring_index("entity", ":", 1)).withColumn("value", F.expr("substring(entity, instr(entity, ':') + 1)")).withColumn("h", h)
    byte = lambda i: F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int")
    digit = lambda i: F.pmod(F.conv(F.substring("h", 3 * i + 1, 3), 16, 10).cast("int"), F.lit(10)).cast("string")
    fresh, size = F.concat(*[digit(i) for i in range(20)]), F.length("value")
    # a telephone keeps what stands before its last ten digits, its first digit at least
    code = F.greatest(size - 10, F.lit(1))
    phone = F.concat(F.substring("value", F.lit(1), code), F.lit("5"), F.substring(fresh, F.lit(1), F.greatest(size - code - 1, F.lit(0))))
    # a card whose check sum is right gets a surrogate whose check sum is right
    rows = rows.withColumn("body", F.concat(F.lit("9"), F.substring(fresh, F.lit(1), size - 2))).withColumn("zero", F.concat("body", F.lit("0")))
    right = F.pmod(F.lit(10) - F.expr(_LUHN.format("zero")), F.lit(10)).cast("string")
    card = F.concat("body", F.when(F.expr(_LUHN.format("value")) == 0, right).otherwise(F.pmod(F.ascii(F.substring("h", 64, 1)), F.lit(10)).cast("string")))
    ip = F.concat_ws(".", (F.pmod(byte(0), F.lit(16)) + 240).cast("string"), *[byte(i).cast("string") for i in (1, 2, 3)])
    # one domain has one surrogate, under a name that cannot exist; short local parts grow when they keep colliding
    domain = F.concat(F.lit("d"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.substring_index("value", "@", -1)), 256), 1, 10), F.lit(".example"))
    longer = F.when(F.col("turn") > 4, F.concat(F.lit("."), F.substring("h", 1, 6))).otherwise("")
    email = F.concat(F.expr(_LOCAL), longer, F.lit("@"), domain)
    type_ = F.col("type")
    surrogate = F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "card", card).when(type_ == "phone", phone).otherwise(_made_up_name(byte))
    return rows.select("entity", "turn", F.concat("type", F.lit(":"), surrogate).alias("surrogate"))


def assign_surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """entity, surrogate for each of the distinct entities, as a table in scratch that the caller drops. No two of a type share a surrogate and none is an entity that occurs. What else it wrote is dropped, for it has entities in clear."""
    entities = scratch.save(entities.select("entity").distinct(), "entities")
    done, left, spent = None, entities.withColumn("turn", F.lit(0)), [entities]
    for turn in range(ROUNDS):
        drawn = scratch.save(draw_surrogates(left, key), "drawn")
        free = drawn.join(entities.withColumnRenamed("entity", "surrogate"), "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        won = free.groupBy("surrogate").agg(F.min("entity").alias("entity")).select("entity", "surrogate")
        before, done = done, scratch.save(won if done is None else done.union(won), "done")
        left = scratch.save(entities.join(done, "entity", "left_anti").withColumn("turn", F.lit(turn + 1)), "left")
        spent += [drawn, left] + ([] if before is None else [before])
        if left.isEmpty():
            scratch.drop(*spent)
            return done
    raise RuntimeError("some entities found no free surrogate: their format has too few values")


def _rewritten() -> Column:
    """A mention m in its own format, with the surrogates v1 and, of given names, v2 (an array) in it."""
    digits = F.expr("aggregate(split(m, ''), struct('' AS out, 1 AS k), (a, c) -> if(c RLIKE '[0-9]', struct(concat(a.out, substring(v1, a.k, 1)) AS out, a.k + 1 AS k), struct(concat(a.out, c) AS out, a.k AS k)), a -> a.out)")
    title = F.regexp_extract("m", rf"^((?:{_TITLE})\.?\x20)", 1)
    return F.when(F.col("kind").isin("phone", "card"), digits).when(F.col("kind") == "name", F.concat(title, F.array_join(F.concat("v2", F.array("v1")), " "))).otherwise(F.col("v1"))


def _untitled(gap: Column, names: Column) -> Column:
    """gap with the surrogates of names (old, new) for the words that are such names; a possessive ending stays."""
    own = lambda t: F.regexp_replace(t, "['’]s$|['’-]+$", "")
    one = lambda t: F.coalesce(F.get(F.filter(names, lambda n: n["old"] == own(t)), F.lit(0))["new"], own(t))
    word = lambda t: F.when(t.rlike(r"^\p{Lu}"), F.concat(one(t), F.substring(t, F.length(own(t)) + 1, F.length(t)))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(_PIECE), F.lit(0)), word), "")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_email, n_name, n_phone, n_ip, n_card, text for each row of docs; text has surrogates for the entities.

    The key decides the surrogates; without it they can't be told from the entities. The words of a titled name get their
    surrogates wherever they stand in the same text, with a title or without; n_name counts titled ones. (A word that is a
    surname and a given name there is taken for the surname.) Null texts stay null and count nothing. Repeated rows give equal
    rows. An empty table gives none. Scratch keeps keyed hashes of mentions and their surrogates, nothing in clear.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    may = F.col("text").rlike(r"[0-9@]") | F.col("text").rlike(rf"(?:{_TITLE})\.?\x20\p{{Lu}}")
    mentions = F.when(F.coalesce(may, F.lit(False)), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = rows.withColumn("ms", mentions)
    keyed = scratch.save(_keys(found.select(F.explode("ms").alias("m")).groupBy("m").count()), "keyed")
    entities = keyed.select(F.explode(F.concat(F.array("e1"), "e2")).alias("entity"))
    assigned = assign_surrogates(entities, key, scratch)
    given = assigned.select("entity", F.expr("substring(surrogate, instr(surrogate, ':') + 1)").alias("v"))
    hashed = lambda m: F.sha2(F.concat_ws("|", F.lit(key), m), 256)
    few = given.count() <= MOST_BROADCAST
    parts = keyed.select("m", "kind", F.posexplode(F.concat("e2", F.array("e1"))).alias("i", "entity")).join(F.broadcast(given) if few else given, "entity")
    named = parts.groupBy("m", "kind").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("vs"))
    named = named.select("m", "kind", F.element_at("vs", -1).alias("v1"), F.slice("vs", F.lit(1), F.size("vs") - 1).alias("v2"))
    named = scratch.save(named.select(hashed(F.col("m")).alias("k"), "kind", _rewritten().alias("s")), "mentions")
    scratch.drop(assigned, keyed)
    side = F.broadcast(named) if named.count() <= MOST_BROADCAST else named

    counts = [f"n_{k}" for k in KINDS]
    without = found.where(F.size("ms") == 0).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in counts], "text")
    some = found.where(F.size("ms") > 0).select(F.monotonically_increasing_id().alias("row"), "doc_id", "ms", F.split("text", ANY).alias("gaps"))
    pieces = some.select("row", "doc_id", F.posexplode("gaps").alias("i", "gap"), F.col("ms")).select("row", "doc_id", "i", "gap", F.expr("get(ms, i)").alias("m"))
    # the text behind the last mention has none itself; it joins nothing, under a key of its own row lest all meet in one task
    joined = pieces.withColumn("k", F.coalesce(F.when(F.col("m").isNotNull(), hashed(F.col("m"))), F.concat(F.lit("-:"), F.col("row").cast("string")))).join(side, "k", "left")
    # old and new words of a titled name, its surname first
    bare = lambda c: F.reverse(F.split(F.regexp_replace(c, rf"^(?:{_TITLE})\.?\x20", ""), " "))
    names = F.when(F.col("kind") == "name", F.arrays_zip(bare(F.col("m")).alias("old"), bare(F.col("s")).alias("new")))
    written = joined.select("row", "doc_id", "i", "gap", "kind", F.coalesce("s", F.lit("")).alias("s"), names.alias("names"))
    pieces = F.array_sort(F.collect_list(F.struct("i", "gap", "s"))).alias("pieces")
    whole = written.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], pieces, F.collect_set("names").alias("names"))
    last, rest = F.transform("names", lambda n: n[0]), F.flatten(F.transform("names", lambda n: F.slice(n, F.lit(2), F.size(n))))
    whole = whole.withColumn("names", F.array_distinct(F.concat(last, rest)))
    gap = lambda x: F.when(F.size("names") > 0, _untitled(x["gap"], F.col("names"))).otherwise(x["gap"])
    whole = whole.withColumn("text", F.array_join(F.transform("pieces", lambda x: F.concat(gap(x), x["s"])), ""))
    return without.union(whole.select("doc_id", *counts, "text"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replace_entities on documents. The key is the session's setting spark.tierstone.pii.key; the default, which everybody can read, serves tests only."""
    return replace_entities(table(spark, sf_dir, "documents"), key=spark.conf.get("spark.tierstone.pii.key", "tierstone"))
