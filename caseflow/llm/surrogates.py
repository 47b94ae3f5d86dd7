"""Personal data replaced by keyed surrogates.

Entities are found by pattern, and each distinct entity gets one surrogate of its own type: telephone, card and IPv4 numbers
go through a keyed permutation of their digits (a telephone number keeps its country code, a card number its first digit and a valid check digit), e-mail addresses keep their shape and
their domain's identity. A mention keeps its own punctuation.

Names are found next to a title, and where a document has a titled name, its mentions without one are found as well: the whole name, the family name and the first name. A name is
replaced token by token, the family name by one of its script, the first name by one of its gender and script, so that a person stays one over all forms and titles.
A first name after a title without a gender follows the gender that the same name has elsewhere. Scripts are Latin, Cyrillic and Han.

Coreference holds because a surrogate depends on the key and the entity alone, distinctness because surrogates are checked over
the whole corpus: one that another entity has, or that is itself an entity of the corpus, is drawn again until none is left.

Everything is DataFrame functions. Distinct entities are the only rows that are shuffled for the mapping. Documents meet it by
their list of entities, so copies of a document share one row of it, and documents without entities move nowhere.

Null and empty texts come back as they are, and very long ones are rewritten whole. Rows are rewritten one by one; an empty table gives an empty result; columns other
than the text and ``keep`` are ignored, and those of ``keep`` that clash with a result are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.secrets import SPAN, spans
from caseflow.session import pin

_NAME = r"\p{Lu}\p{L}+(?:\x20\p{Lu}\p{L}+)?"
_MALE, _FEMALE, _ANY = "Mr|Herr|Sr|Señor|Monsieur|Don|г-н", "Mrs|Ms|Miss|Frau|Sra|Señora|Madame|Mme|Doña|г-жа", "Dr|Prof"
#: Common Han family names, and the titles that follow a name.
_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧"
_HAN_MALE, _HAN_FEMALE = "先生", "女士|小姐|太太"

#: Kind: (what a text with one contains, the pattern).
PATTERNS = {
    "email": (r"@", r"[\p{L}\p{N}._%+-]*[\p{L}\p{N}]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "phone": (r"[0-9]{3}[ .-][0-9]{4}", r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    # Any international number: a country code and groups of up to four digits, with or without something between them.
    "phone_i": (r"\+[1-9]", r"(?<![\p{L}\p{N}+])\+[1-9][0-9]{0,2}(?:[ ./-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,7}(?![0-9])"),
    "card": (
        r"[0-9]{13}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -]",
        r"(?<![\p{L}\p{N}])(?:[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![\p{L}\p{N}])",
    ),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[\p{L}\p{N}])"),
    "person_m": (_MALE, rf"(?<=(?<!\p{{L}})(?:{_MALE})\.?\x20){_NAME}"),
    "person_f": (_FEMALE, rf"(?<=(?<!\p{{L}})(?:{_FEMALE})\.?\x20){_NAME}"),
    "person_x": (_ANY, rf"(?<=(?<!\p{{L}})(?:{_ANY})\.?\x20){_NAME}"),
    "han_m": (_HAN_MALE, rf"[{_HAN}]\p{{IsHan}}{{0,2}}(?={_HAN_MALE})"),
    "han_f": (_HAN_FEMALE, rf"[{_HAN}]\p{{IsHan}}{{0,2}}(?={_HAN_FEMALE})"),
}

#: First names by gender and script, and syllables of family names by script.
FIRST = {
    ("person_m", "latin"): ("Anton", "Bruno", "Carl", "Daniel", "Felix", "Martin", "Oscar", "Victor"),
    ("person_f", "latin"): ("Anna", "Clara", "Elena", "Irene", "Julia", "Laura", "Maria", "Sara"),
    ("person_x", "latin"): ("Alex", "Andrea", "Kim", "Luca", "Nico", "Robin", "Sascha", "Toni"),
    ("person_m", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Олег", "Павел", "Сергей", "Юрий"),
    ("person_f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Юлия"),
    ("person_x", "cyrillic"): ("Саша", "Женя", "Валя", "Шура"),
}
SYLLABLES = {
    "latin": ("bar", "den", "fel", "gor", "han", "kel", "lin", "mor", "nal", "per", "ros", "sel", "tan", "vel", "win", "zor"),
    "cyrillic": ("бар", "вел", "гор", "дан", "кир", "лан", "мор", "нел", "рос", "сам", "тар", "хол"),
}
#: Second characters of Han names by gender, and third ones.
GIVEN = {"han_m": "伟强磊军洋勇杰涛明超刚平辉鹏", "han_f": "芳娜敏静丽艳娟霞秀燕玲婷雪倩", "third": "华文安宁瑞晨思远嘉景"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ROUNDS = 6


def _luhn(digits: str, start: int) -> str:
    """Sum of the digits with every second one doubled, from the right, beginning with the ``start``-th."""
    return f"""aggregate(split(reverse({digits}), ''), named_struct('s', 0, 'i', 0), (a, c) -> named_struct('s',
        a.s + IF(a.i % 2 = {start}, CAST(c AS int) * 2 - IF(CAST(c AS int) > 4, 9, 0), CAST(c AS int)), 'i', a.i + 1), a -> a.s)"""


def find_entities(text: str) -> Column:
    """Entities of column ``text`` in order, without overlaps: (kind, start, end, value, canon)."""
    found = []
    for kind, (hint, pattern) in PATTERNS.items():
        keep = "true"
        if kind == "card":
            keep = _luhn("regexp_replace(hit.`1`, '[ -]', '')", 1) + " % 10 = 0"
        elif kind == "phone_i":
            keep = "length(regexp_replace(hit.`1`, '[^0-9]', '')) BETWEEN 8 AND 15"
        seen = F.col(text).contains("@") if hint == "@" else F.col(text).rlike(hint)
        found.append(F.when(seen, spans(text, pattern, kind.removesuffix("_i"), keep)).otherwise(F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint>>)")))
    return F.concat(*found)


def _resolved(array: str, text: str) -> Column:
    """Sorted by place, longer first, overlapping later ones left out, with value and canonical form."""
    value = f"substring({text}, CAST(x.start + 1 AS int), CAST(x.end - x.start AS int))"
    canon = f"""CASE WHEN x.kind = 'email' THEN lower({value}) WHEN x.kind IN ('phone', 'card') THEN regexp_replace({value}, '[^0-9]', '') ELSE {value} END"""
    return F.expr(f"""
        transform(
            aggregate(array_sort(transform({array}, x -> named_struct('start', x.start, 'back', -x.end, 'kind', x.kind))),
                named_struct('at', 0L, 'out', CAST(array() AS array<struct<kind:string,start:bigint,end:bigint>>)),
                (acc, x) -> IF(x.start < acc.at, acc, named_struct('at', -x.back, 'out', concat(acc.out, array(named_struct('kind', x.kind, 'start', x.start, 'end', -x.back))))),
                acc -> acc.out),
            x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'value', {value}, 'canon', {canon}))""")


def _untitled(found: DataFrame) -> DataFrame:
    """``found`` (text, entities) with the other mentions of names that a document has with a title, and ``parts``: what each entity is replaced by, token by token."""
    person = lambda e: e["kind"].startswith("person")
    found = found.withColumn("_names", F.transform(F.filter("entities", person), lambda e: F.struct(e["value"].alias("value"), e["kind"].alias("kind"))))
    tokens = F.expr("array_distinct(flatten(transform(_names, n -> concat(array(n.value), split(n.value, ' ')))))")
    # Longer ones first, so that a whole name is not taken for its parts. Names are letters and blanks, which stand for themselves in a pattern.
    listed = F.expr("array_join(transform(array_sort(transform(_tokens, t -> named_struct('n', -length(t), 't', t))), x -> x.t), '|')")
    found = found.withColumn("_tokens", tokens).withColumn("_pattern", F.concat(F.lit(r"(?<!\p{L})(?:"), listed, F.lit(r")(?!\p{L})")))
    again = F.expr(f"""
        aggregate(arrays_zip(split(text, _pattern), regexp_extract_all(text, _pattern, 0)), named_struct('at', 0L, 'found', CAST(array() AS {SPAN})),
            (acc, hit) -> named_struct('at', acc.at + length(hit.`0`) + coalesce(length(hit.`1`), 0),
                'found', CASE WHEN hit.`1` IS NOT NULL THEN concat(acc.found, array(named_struct(
                    'kind', 'person_y', 'start', acc.at + length(hit.`0`), 'end', acc.at + length(hit.`0`) + length(hit.`1`)))) ELSE acc.found END),
            acc -> acc.found)""")
    known = F.expr("transform(entities, e -> named_struct('kind', e.kind, 'start', e.start, 'end', e.end))")
    found = found.withColumn("_all", F.when(F.size("_names") > 0, F.concat(known, again)))
    found = found.withColumn("entities", F.when(F.size("_names") > 0, _resolved("_all", "text")).otherwise(F.col("entities")))
    # A first name has the gender of a title that the name has in this document, if any has one.
    gender = "substring(coalesce(array_min(transform(filter(_names, n -> startswith(n.value, concat({}, ' '))), n -> n.kind)), 'person_x'), 8)"
    whole = gender.format("split(e.value, ' ')[0]")
    parts = F.expr(f"""transform(entities, e -> CASE
        WHEN NOT startswith(e.kind, 'person') THEN array(named_struct('kind', e.kind, 'canon', e.canon))
        WHEN contains(e.value, ' ') THEN array(named_struct('kind', concat('first_', {whole}), 'canon', split(e.value, ' ')[0]), named_struct('kind', 'family', 'canon', split(e.value, ' ')[1]))
        WHEN e.kind = 'person_y' AND exists(_names, n -> startswith(n.value, concat(e.value, ' '))) AND NOT exists(_names, n -> n.value = e.value OR endswith(n.value, concat(' ', e.value)))
            THEN array(named_struct('kind', concat('first_', {gender.format("e.value")}), 'canon', e.value))
        ELSE array(named_struct('kind', 'family', 'canon', e.value)) END)""")
    return found.withColumn("parts", parts).drop("_names", "_tokens", "_pattern", "_all")


def _number(*parts: Column | str) -> Column:
    """A keyed number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def draw(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canon, attempt) with the surrogate of their canonical form."""
    secret = F.lit(key)
    c = F.col
    # What is permuted of a telephone number: all of a national one; the country code stays, one digit of +1 and two of others.
    national = F.expr("IF(length(canon) <= 10, canon, substring(canon, IF(length(canon) = 11 AND startswith(canon, '1'), 2, 3)))")
    digits = F.when(c("kind") == "phone", national).when(c("kind") == "card", F.expr("substring(canon, 2, length(canon) - 2)"))
    step = entities.withColumn("_body", digits)
    octet = lambda i: F.split("canon", r"\.")[i].cast("long")
    is_ip, is_number = c("kind") == "ip", c("_body").isNotNull()
    half = F.expr("length(_body) div 2")
    step = step.withColumns({
        "_l": F.when(is_ip, octet(0) * 256 + octet(1)).when(is_number, F.expr("CAST(substring(_body, 1, length(_body) div 2) AS bigint)")),
        "_r": F.when(is_ip, octet(2) * 256 + octet(3)).when(is_number, F.expr("CAST(substring(_body, 1 + length(_body) div 2) AS bigint)")),
        "_lm": F.when(is_ip, F.lit(65536)).otherwise(F.pow(F.lit(10.0), half).cast("long")),
        "_rm": F.when(is_ip, F.lit(65536)).otherwise(F.pow(F.lit(10.0), F.length("_body") - half).cast("long")),
    })
    tweak = F.concat_ws(":", "kind", F.length("canon"), F.when(is_number, F.expr("substring(canon, 1, length(canon) - length(_body) - IF(kind = 'card', 1, 0))")), "attempt")
    for number in range(ROUNDS):  # each round shifts one half by a keyed function of the other, which can be undone
        one, other = ("_l", "_r") if number % 2 == 0 else ("_r", "_l")
        step = step.withColumn(one, (c(one) + _number(secret, F.lit(number), tweak, c(other).cast("string"))) % c(f"{one}m"))
    left = F.expr("lpad(CAST(_l AS string), length(_body) div 2, '0')")
    right = F.expr("lpad(CAST(_r AS string), length(_body) - length(_body) div 2, '0')")
    step = step.withColumn("_whole", F.when(c("kind") == "card", F.concat(F.substring("canon", 1, 1), left, right)))
    card = F.concat("_whole", F.expr(f"CAST((10 - {_luhn('_whole', 0)} % 10) % 10 AS string)"))
    phone = F.concat(F.expr("substring(canon, 1, length(canon) - length(_body))"), left, right)
    ip = F.expr("concat_ws('.', CAST(_l div 256 AS string), CAST(_l % 256 AS string), CAST(_r div 256 AS string), CAST(_r % 256 AS string))")
    step = step.withColumn("_noise", F.sha2(F.concat_ws("|", secret, "kind", "canon", "attempt"), 512))
    shape = F.expr(f"""array_join(transform(split(substring_index(canon, '@', 1), ''), (ch, i) -> CASE
        WHEN ch RLIKE '[0-9]' THEN CAST(CAST(conv(substring(_noise, 1 + (i * 3) % 125, 3), 16, 10) AS int) % 10 AS string)
        WHEN ch RLIKE '\\\\p{{L}}' THEN substring('{LETTERS}', 1 + CAST(conv(substring(_noise, 1 + (i * 3) % 125, 3), 16, 10) AS int) % 26, 1)
        ELSE ch END), '')""")
    more = F.when(c("attempt") > 2, F.substring("_noise", 1, 8)).otherwise("")
    domain = F.substring_index("canon", "@", -1)
    email = F.concat(shape, more, F.lit("@m"), F.substring(F.sha2(F.concat_ws("|", secret, domain), 256), 1, 8), F.lit(".example."), F.substring_index(domain, ".", -1))

    def chosen(options: tuple[str, ...], *tag: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (1 + _number(secret, *tag, "kind", "canon", "attempt") % len(options)).cast("int"))

    again = F.when(c("attempt") > 1, F.expr("array_join(transform(split(CAST(attempt AS string), ''), d -> substring('nrlstmkdvb', 1 + CAST(d AS int), 1)), '')")).otherwise("")
    cyrillic = c("canon").rlike(r"\p{IsCyrillic}")
    name = F.lit(None).cast("string")
    for (person, script), options in FIRST.items():
        kind = person.replace("person", "first")
        # More names than there are first names are told apart by twos and threes.
        more = F.when(c("attempt") > 3, F.concat(F.lit("-"), chosen(options, F.lit("second")))).otherwise("")
        third = F.when(c("attempt") > 5, F.concat(F.lit("-"), chosen(options, F.lit("third")), again)).otherwise("")
        name = F.when((c("kind") == kind) & (cyrillic if script == "cyrillic" else ~cyrillic), F.concat(chosen(options, F.lit("first")), more, third)).otherwise(name)
    for script, options in SYLLABLES.items():
        ends = [chosen(options, F.lit(f"family{i}")) for i in range(4)]
        # Cyrillic family names tell the gender by their end.
        gendered = F.when(c("canon").rlike("[ая]$"), "ова").otherwise("ов") if script == "cyrillic" else F.lit("")
        family = F.initcap(F.concat(*ends[:3], F.when(c("attempt") > 0, ends[3]).otherwise(""), again, gendered))
        name = F.when(((c("kind") == "family") | c("kind").startswith("person")) & (cyrillic if script == "cyrillic" else ~cyrillic), family).otherwise(name)
    for kind in ("han_m", "han_f"):
        given = F.when((F.length("canon") > 1) | (c("attempt") > 0), chosen(tuple(GIVEN[kind]), F.lit("second"))).otherwise("")
        rest = F.when((F.length("canon") > 2) | (c("attempt") > 1), chosen(tuple(GIVEN["third"]), F.lit("third"))).otherwise("")
        longer = F.when(c("attempt") > 2, F.expr(f"array_join(transform(split(CAST(attempt AS string), ''), d -> substring('{GIVEN['third']}', 1 + CAST(d AS int), 1)), '')")).otherwise("")
        name = F.when(c("kind") == kind, F.concat(chosen(tuple(_HAN), F.lit("surname")), given, rest, longer)).otherwise(name)
    surrogate = F.when(c("kind") == "card", card).when(c("kind") == "phone", phone).when(c("kind") == "ip", ip).when(c("kind") == "email", email).otherwise(name)
    return step.select("kind", "canon", "attempt", surrogate.alias("surrogate"))


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for the distinct entities (kind, canon): surrogates are distinct and none is an entity."""
    known = pin(entities.select("kind", "canon").distinct(), "entities")
    drawn = pin(draw(known.withColumn("attempt", F.lit(0)), key), "drawn")
    originals = known.select(F.regexp_replace("kind", "_.*", "").alias("family"), F.col("canon").alias("surrogate")).distinct()
    while True:
        # Names of all genders share one family; groups of one surrogate are as small as collisions are rare.
        same = W.partitionBy("family", "surrogate").orderBy("attempt", "kind", "canon")
        ranked = drawn.withColumn("family", F.regexp_replace("kind", "_.*", "")).withColumn("place", F.row_number().over(same))
        taken = originals.withColumn("taken", F.lit(True))
        judged = pin(ranked.join(taken, ["family", "surrogate"], "left").select("kind", "canon", "attempt", "surrogate", (F.col("taken").isNotNull() | (F.col("place") > 1)).alias("clash")), "judged")
        if not judged.filter("clash").limit(1).count():
            return judged.select("kind", "canon", "surrogate")
        again = draw(judged.filter("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), key)
        drawn = pin(judged.filter("NOT clash").select("kind", "canon", "attempt", "surrogate").unionByName(again), "drawn")


def of_one_gender(mapping: DataFrame) -> DataFrame:
    """``mapping`` in which a first name after a title without a gender has the surrogate of the same name with one, if there is any."""
    gendered = mapping.filter(F.col("kind").isin("first_m", "first_f")).groupBy("canon").agg(F.max_by("surrogate", "kind").alias("_own"))
    open_ = mapping.filter(F.col("kind") == "first_x").join(gendered, "canon", "left").select("kind", "canon", F.coalesce("_own", "surrogate").alias("surrogate"))
    return mapping.filter(F.col("kind") != "first_x").unionByName(open_)


def replace_entities(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every document with text (rewritten) and entities (kind, start, end in the original, value, canon)."""
    keep = tuple(c for c in keep if c not in {"entities", "text"})
    rows = docs.select(*keep, F.col(text).alias("text"))
    found = rows.withColumn("_all", find_entities("text")).withColumn("entities", F.coalesce(_resolved("_all", "text"), F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint,value:string,canon:string>>)"))).drop("_all")
    found = pin(_untitled(found), "entities-found")
    named = found.filter(F.size("entities") > 0).withColumn("_list", F.flatten("parts"))
    lists = named.select("_list").distinct()
    members = lists.select("_list", F.explode(F.array_distinct("_list")).alias("e")).select("_list", "e.kind", "e.canon")
    mapping = of_one_gender(surrogate_map(members.select("kind", "canon"), key))
    # Written, so that both sides of the join below are read from tables, and a list of very many documents can be split.
    by_list = pin(members.join(mapping, ["kind", "canon"]).groupBy("_list").agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("_map")), "by-list")
    joined = named.join(by_list, "_list", "left")
    new = "array_join(transform(parts[i], p -> transform(filter(_map, m -> m.kind = p.kind AND m.canon = p.canon), m -> m.surrogate)[0]), ' ')"
    # Numbers keep the mention's own punctuation: its digits are replaced one after the other.
    placed = f"""CASE WHEN e.kind IN ('phone', 'card') THEN aggregate(split(e.value, ''), named_struct('out', '', 'at', 1),
        (acc, ch) -> IF(ch RLIKE '[0-9]', named_struct('out', concat(acc.out, substring({new}, acc.at, 1)), 'at', acc.at + 1), named_struct('out', concat(acc.out, ch), 'at', acc.at)), acc -> acc.out)
        ELSE {new} END"""
    rewritten = joined.withColumn("_new", F.expr(f"transform(entities, (e, i) -> named_struct('start', e.start, 'end', e.end, 'put', {placed}))"))
    rewritten = rewritten.withColumn("text", F.expr("""
        transform(array(aggregate(_new, named_struct('at', 0L, 'out', ''),
            (acc, s) -> named_struct('at', s.end, 'out', concat(acc.out, substring(text, CAST(acc.at + 1 AS int), CAST(s.start - acc.at AS int)), s.put)))),
            acc -> concat(acc.out, substring(text, CAST(acc.at + 1 AS int))))[0]"""))
    columns = [*keep, "text", "entities"]  # persons found without a title are of the kind person_y
    return rewritten.select(*columns).unionByName(found.filter(F.size("entities") == 0).select(*columns))
