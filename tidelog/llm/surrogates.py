"""Personal data replaced by surrogates, with DataFrame functions alone.

Entities are found by one pattern.  Each distinct entity gets a surrogate from an HMAC: of the
same type, with letters for letters and digits for digits in the same places, names of the same
gender and script, valid card check digits, reserved e-mail domains.  A surrogate that equals a
real entity of the corpus, or that another entity has, is drawn anew in a further round, so
different entities stay different and one entity has one surrogate in every document.  Names are
found after a title, then replaced in the rest of the same document too.

Texts without entities pass by; only the others, and rows of single entities, are shuffled.  An
entity with more than a thousandth of all rows gets its surrogate by broadcast: there are at most
a thousand of these.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import drop, join_counted, materialise

#: Titles that tell a name, by gender.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа"]
NEUTRAL = ["Dr", "Prof", "Professor", "Mx"]
#: Given names to draw from, by gender and script; family names are made of syllables.
GIVEN = {
    "m_lat": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Kilian Lukas Martin Noel Oscar Paul".split(),
    "f_lat": "Anna Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karin Laura Maria Nora Olga Paula".split(),
    "u_lat": "Alex Ariel Charlie Dominique Eden Francis Jamie Jules Kim Lou Morgan Noa Robin Sacha Sam Toni".split(),
    "m_cyr": "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Семён Фёдор".split(),
    "f_cyr": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Рита Софья".split(),
    "u_cyr": "Валя Женя Саша Слава Паша Никита Миша Шура Тоня Леся Мика Рома Витя Стася Ника Гена".split(),
}
SYLLABLES = {
    "lat": "bar den fel gor han jas kel lom mar nev por ras sel tam vor wen".split(),
    "cyr": "бар вен гор дан зел ков лом мир нев пол рад сел там фор хол чер".split(),
}
#: A word of a name, or an initial; and a further one, after a space or right after an initial.
_NAME = r"(?:[\p{Lu}][\p{L}'’-]+|\p{Lu}\.)"
_FURTHER = rf"(?:(?:[ ]|(?<=\.)){_NAME}){{0,99}}"  # Java matches repeated groups by recursion
#: Words and what lies between them, a genitive, and a capital, in a text whose names are known.
_WORD, _OTHER, _OWNER, _CAPITAL = r"[\p{L}'’-]+", r"[^\p{L}'’-]+", r"['’][sS]$", r"^\p{Lu}"
_any = lambda titles: "|".join(titles + [t.upper() for t in titles])
_TITLE = _any(MALE + FEMALE + NEUTRAL)
#: What is looked for, the more specific first.  No part can begin inside a longer run of its own kind.
PATTERN = "|".join(
    [
        # Java matches repeated groups by recursion, so each has a bound; a host name has at most 127 labels.
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+",
        r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"',;]{6,}",
        r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
        r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
        r"(?<![0-9A-Za-z:])(?:[23][0-9A-Fa-f]{3}|[Ff][CcDdEe][0-9A-Fa-f]{2})(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){0,6}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
        r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
        rf"(?<![\p{{L}}])(?:{_TITLE})(?:\.[ ]?|[ ]){_NAME}{_FURTHER}",
    ]
)
#: Without this in it a text has no entity.  Most characters fail one class and are passed by at once.
_FIRST = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL} | set("Agsx")))
TRIGGER = rf"[0-9@=:]|(?=[{_FIRST}])(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|(?<![\p{{L}}])(?:{_TITLE})[. ])"
#: Rounds after which a surrogate is longer than what it stands for.
LONGER_AFTER = 4
#: Rounds that suffice by far; from then on something is wrong.
MOST_ROUNDS = 40
#: The session's setting that holds the key.
KEY_SETTING = "spark.tidelog.surrogates.key"


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting ``KEY_SETTING``; without it a random one, so that surrogates of this run can't be told by anyone, nor repeated."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def entities(text: Column) -> Column:
    """What the pattern finds in a text, in order (null: nothing); numbers that no card has are among it."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(TRIGGER), found).otherwise(F.array().cast("array<string>"))


def _mac(key: str, message: str) -> str:
    """HMAC-SHA-512 of ``message`` in hex, by its definition: SQL has only the hash."""
    block = key.encode()
    block = (hashlib.sha512(block).digest() if len(block) > 128 else block).ljust(128, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode({message}, 'UTF-8')), 512))), 512)"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(raw: str) -> str:
    return f"""CASE WHEN {raw} LIKE '%@%' AND {raw} NOT RLIKE '[=:]' THEN 'email'
      WHEN {raw} RLIKE {_sql(rf'^(?:{_TITLE})[. ]')} THEN 'name'
      WHEN {raw} RLIKE '^[0-9A-Fa-f]{{4}}:' THEN 'ipv6'
      WHEN {raw} RLIKE {_sql(r'^(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]')} THEN 'assigned'
      WHEN {raw} RLIKE {_sql(r'^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?:gh[pousr]_|sk-|xox[abp]-)')} THEN 'secret'
      WHEN {raw} RLIKE '^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban'
      WHEN {raw} RLIKE {_sql(r'^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$')} THEN 'ip'
      WHEN {raw} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
      WHEN {raw} RLIKE {_sql(r'^\+|^\(|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$')} THEN 'phone'
      WHEN {_luhn(f"regexp_replace({raw}, '[^0-9]', '')", f"length(regexp_replace({raw}, '[^0-9]', ''))")} % 10 = 0 THEN 'card' ELSE '' END"""


def _atoms(raw: str, kind: str) -> str:
    """An entity in parts, of which each is kept (kind '') or replaced: array of (kind, part)."""
    token = f"regexp_extract_all({raw}, {_sql(r'([ ]+|[^ .]+[.]?)')}, 1)"
    male, female = _any(MALE), _any(FEMALE)
    gender = f"CASE WHEN {raw} RLIKE {_sql(rf'^(?:{male})[. ]')} THEN 'm' WHEN {raw} RLIKE {_sql(rf'^(?:{female})[. ]')} THEN 'f' ELSE 'u' END"
    script = "CASE WHEN x RLIKE '[\\\\u0400-\\\\u04FF]' THEN 'cyr' ELSE 'lat' END"
    names = f"""transform({token}, (x, i) -> named_struct('kind',
        CASE WHEN i = 0 OR x LIKE ' %' THEN '' WHEN x RLIKE {_sql(r'^\p{Lu}\.$')} THEN 'initial' WHEN i = size({token}) - 1 THEN concat('family_', {script})
             ELSE concat('given_', {gender}, '_', {script}) END, 'part', x))"""
    ahead = _sql(r"^([A-Za-z_-]+\s*[=:]\s*[\"']?)(.*)$")
    assigned = f"array(named_struct('kind', '', 'part', regexp_extract({raw}, {ahead}, 1)), named_struct('kind', 'secret', 'part', regexp_extract({raw}, {ahead}, 2)))"
    return f"CASE {kind} WHEN 'name' THEN {names} WHEN 'assigned' THEN {assigned} ELSE array(named_struct('kind', {kind}, 'part', {raw})) END"


def _canon(kind: str, part: str) -> str:
    """What is one entity however it is written."""
    return f"""CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN regexp_replace({part}, '[^0-9]', '')
      WHEN {kind} = 'iban' THEN replace({part}, ' ', '') WHEN {kind} IN ('secret', 'ip') THEN {part} WHEN {kind} = '' THEN '' ELSE lower({part}) END"""


def _luhn(digits: str, n: str) -> str:
    """Sum of a number's Luhn values, of which the last digit's place counts once."""
    d = f"CAST(substr({digits}, i, 1) AS INT)"
    return f"aggregate(sequence(1, {n}), 0, (s, i) -> s + CASE WHEN ({n} - i) % 2 = 0 THEN {d} WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END)"


def _surrogate(turn: int) -> str:
    """The surrogate of ``canon`` of ``kind`` in a round; ``hex`` holds its authentication code."""
    h = "CAST(conv(substr(hex, ((i * 4) % 252) + 1, 4), 16, 10) AS INT)"
    pick = lambda letters: f"substr('{letters}', ({h} % {len(letters)}) + 1, 1)"
    lower, upper, digit, sixteen = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

    def shape(text: str, keep: str = "false") -> str:
        # By characters: the i-th character of a text costs i steps.
        return f"""array_join(transform(split({text}, ''), (c, i) -> CASE WHEN {keep} THEN c WHEN c RLIKE '[0-9]' THEN {pick(digit)}
            WHEN c RLIKE '[a-z]' THEN {pick(lower)} WHEN c RLIKE '[A-Z]' THEN {pick(upper)} WHEN c RLIKE '[^\\\\x00-\\\\x7F]' THEN {pick(lower)} ELSE c END), '')"""

    longer = f"substr(hex, 200, {turn - LONGER_AFTER + 1})" if turn >= LONGER_AFTER else "''"
    digits_longer = f"translate({longer}, 'abcdef', '012345')"
    hexed = f"array_join(transform(sequence(1, length(canon)), i -> {pick(sixteen)}), '')"
    phone = f"""concat(array_join(transform(sequence(1, length(canon)), i -> CASE WHEN i <= length(canon) - 10 THEN substr(canon, i, 1)
        WHEN i = length(canon) - 9 THEN CAST(2 + {h} % 8 AS STRING) ELSE {pick(digit)} END), ''), {digits_longer})"""
    number = f"concat(substr(canon, 1, 1), array_join(transform(sequence(2, length(canon) - 1), i -> {pick(digit)}), ''), {digits_longer})"
    check = f"CAST((10 - {_luhn(f'concat({number}, \'0\')', f'length({number}) + 1')} % 10) % 10 AS STRING)"
    card = f"concat({number}, {check})"
    # Once rounds bring little, addresses of 192.168 go to the wider 10, later to any network, at last to numbers that no address has.
    octet = "CAST(conv(substr(hex, 10 + k * 8, 6), 16, 10) AS INT) % 256"
    private = "WHEN canon RLIKE '^10[.]' AND k = 0 OR canon RLIKE '^127[.]' AND k = 0 THEN o "
    if turn < LONGER_AFTER:
        private += "WHEN canon RLIKE '^192[.]168[.]' AND k < 2 THEN o "
    elif turn < 2 * LONGER_AFTER:
        private += "WHEN canon RLIKE '^192[.]168[.]' AND k = 0 THEN '10' "
    else:
        private = ""
    if turn >= 3 * LONGER_AFTER:
        octet = "256 + CAST(conv(substr(hex, 10 + k * 8, 6), 16, 10) AS INT) % 744"
    octets = f"""array_join(transform(split(canon, '[.]'), (o, k) -> CASE
        {private}WHEN k = 0 THEN CAST(element_at(filter(sequence(1, 223), x -> x NOT IN (10, 127, 172, 192)), 1 + CAST(conv(substr(hex, 1, 6), 16, 10) AS INT) % 219) AS STRING)
        ELSE CAST({octet} AS STRING) END), '.')"""
    # A further group in front of the last one is a form that no real address of eight groups has.
    nibble = f"CASE WHEN i = 1 OR substr(canon, i, 1) = ':' THEN substr(canon, i, 1) ELSE {pick(sixteen)} END"
    groups = f"concat(array_join(transform(sequence(1, length(canon)), i -> {nibble}), ''), {f"concat(':', substr(hex, 200, {min(4, turn - LONGER_AFTER + 1)}))" if turn >= LONGER_AFTER else "''"})"
    domain = f"substr(canon, instr(canon, '@') + 1)"
    host = f"regexp_replace({domain}, '(?:[.]example)?[.][a-z0-9-]+$', '')"
    email = f"concat({shape("substr(canon, 1, instr(canon, '@') - 1)")}, {longer}, '@', CASE WHEN {host} IN ('', 'example') THEN '' ELSE concat({shape(host)}, '.') END, 'example.', element_at(array('com', 'org', 'net'), 1 + CAST(conv(substr(hex, 240, 4), 16, 10) AS INT) % 3))"
    h_at = lambda at: f"CAST(conv(substr(hex, {at}, 4), 16, 10) AS INT)"
    given = " ".join(f"WHEN kind = 'given_{k}' THEN concat(element_at(array({', '.join(map(_sql, v))}), 1 + {h_at(1)} % {len(v)}), {_syllables(k[2:], max(0, turn - 1), 41, h_at)})" for k, v in GIVEN.items())
    family = " ".join(f"WHEN kind = 'family_{k}' THEN initcap({_syllables(k, 3 + turn, 81, h_at)})" for k in SYLLABLES)
    return f"""CASE WHEN kind = 'email' THEN {email} WHEN kind = 'phone' THEN {phone} WHEN kind = 'card' THEN {card} WHEN kind = 'ip' THEN {octets}
      WHEN kind = 'ipv6' THEN {groups}
      WHEN kind = 'ssn' THEN concat({shape('canon')}, {digits_longer}) WHEN kind = 'iban' THEN concat({shape('canon', 'i < 2')}, {digits_longer})
      WHEN kind = 'secret' AND canon RLIKE '^[0-9a-f]+$' THEN concat({hexed}, {longer})
      WHEN kind = 'secret' THEN concat({shape('canon', "i < length(regexp_extract(substr(canon, 1, 5), '^(AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)', 1))")}, {longer})
      {given} {family} END"""


def _syllables(script: str, n: int, at: int, h_at) -> str:
    own = SYLLABLES[script]
    parts = [f"element_at(array({', '.join(map(_sql, own))}), 1 + {h_at(at + 4 * k)} % {len(own)})" for k in range(min(n, 12))]
    return f"concat({', '.join(parts)})" if parts else "''"


def _layout(kind: str, part: str, surrogate: str) -> str:
    """The surrogate written as the part was: separators, and capitals of names, stay."""
    nth = f"length(regexp_replace(substr({part}, 1, i), '[^0-9]', ''))"
    spread = f"""concat(array_join(transform(sequence(1, length({part})), i -> CASE WHEN substr({part}, i, 1) RLIKE '[0-9]' THEN substr({surrogate}, {nth}, 1) ELSE substr({part}, i, 1) END), ''),
        substr({surrogate}, length(regexp_replace({part}, '[^0-9]', '')) + 1))"""
    solid = f"length(replace(substr({part}, 1, i), ' ', ''))"
    iban = f"""concat(array_join(transform(sequence(1, length({part})), i -> CASE WHEN substr({part}, i, 1) = ' ' THEN ' ' ELSE substr({surrogate}, {solid}, 1) END), ''),
        substr({surrogate}, length(replace({part}, ' ', '')) + 1))"""
    return f"""CASE WHEN {surrogate} IS NULL THEN {part} WHEN {kind} IN ('phone', 'card', 'ssn') THEN {spread} WHEN {kind} = 'iban' THEN {iban}
      WHEN ({kind} = 'ipv6' OR {kind} LIKE 'given%' OR {kind} LIKE 'family%') AND {part} = upper({part}) THEN upper({surrogate}) ELSE {surrogate} END"""


def _initial(part: str, key: str) -> str:
    """Another letter for an initial, the same everywhere: the alphabet is turned by a number that the key gives."""
    by = int.from_bytes(hmac.digest(key.encode(), b"initial", "sha512")[:8], "big")
    turned = lambda letters: f"substr('{letters * 2}', instr('{letters}', substr({part}, 1, 1)) + {1 + by % (len(letters) - 1)}, 1)"
    latin, cyrillic = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"
    return f"concat(CASE WHEN instr('{cyrillic}', substr({part}, 1, 1)) > 0 THEN {turned(cyrillic)} ELSE {turned(latin)} END, '.')"


def _renamed(text: str, parts: str, names: str) -> str:
    """``text`` with the document's names replaced where they stand without a title; ``parts`` holds them in small letters, ``names`` their surrogates."""
    say = lambda x: f"transform(array(get({names}, CAST(array_position({parts}, lower({x})) AS INT) - 1)), n -> IF({x} = upper({x}), upper(n), n))[0]"
    stem = f"regexp_replace(w, {_sql(_OWNER)}, '')"
    words = f"regexp_extract_all({text}, {_sql(f'({_WORD}|{_OTHER})')}, 1)"
    return f"""array_join(transform({words}, w -> CASE WHEN w RLIKE {_sql(_CAPITAL)}
      THEN coalesce({say('w')}, concat({say(stem)}, substr(w, length({stem}) + 1)), w) ELSE w END), '')"""


def draw(found: DataFrame, key: str) -> DataFrame:
    """A surrogate for each distinct entity (kind, canon): kind, canon, surrogate.

    Surrogates of a kind differ from each other and from every real entity of that kind.  Few
    rounds do: from round ``LONGER_AFTER`` on there is more room each time, whatever is taken."""
    left, rounds = found.select("kind", "canon"), []
    for turn in range(MOST_ROUNDS):
        codes = [_mac(key, f"concat('{turn}|{k}|', kind, '|', canon)") for k in range(2)]
        tried = left.selectExpr("kind", "canon", f"concat({', '.join(codes)}) AS hex").selectExpr("kind", "canon", f"{_surrogate(turn)} AS surrogate")
        same = F.when(F.col("kind").isin("secret", "ip", "phone", "card", "ssn", "iban"), F.col("surrogate")).otherwise(F.lower("surrogate"))
        tried = materialise(tried.withColumn("same", same), "tried")
        first = tried.groupBy("kind", "same").agg(F.min("canon").alias("canon"))
        good = tried.join(first, ["kind", "same", "canon"], "left_semi")
        good = good.join(found.select("kind", F.col("canon").alias("same")), ["kind", "same"], "left_anti")
        for taken in rounds:
            good = good.join(taken.select("kind", "same"), ["kind", "same"], "left_anti")
        rounds.append(materialise(good.select("kind", "canon", "surrogate", "same"), "drawn"))
        left = materialise(tried.join(rounds[-1], ["kind", "canon"], "left_anti").select("kind", "canon"), "undrawn")
        drop(tried)
        if not left.limit(1).count():
            out = rounds[0]
            for more in rounds[1:]:
                out = out.unionByName(more)
            return out.select("kind", "canon", "surrogate")
    raise ArithmeticError(f"entities without a surrogate after {MOST_ROUNDS} rounds")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates for the entities in ``text``, and a column n_entities.

    A null text stays null and has none; other columns stay as they are, apart from n_entities,
    which is replaced and doesn't count names without a title.  Rows are independent of each other,
    but for the surrogates they share.  A number of 13 to 19 digits is a card's only if its check
    digit is right.  The same ``key`` gives the same surrogates for the same table; whoever doesn't
    know it can't test a guess.
    """
    docs = docs.drop("n_entities")
    names = docs.columns
    # Numbers that no card has are found too, as the text is divided by the pattern, but count for nothing.
    true = F.expr(f"CAST(size(filter(_found, x -> NOT (x RLIKE '^[0-9][0-9 -]{{12,}}$' AND {_kind('x')} = ''))) AS LONG)")
    kept_as = {c: "_text" if c == "text" else f"_c{i}" for i, c in enumerate(names)}
    listed = docs.select(*(F.col(c).alias(a) for c, a in kept_as.items())).withColumn("_found", entities(F.col("_text"))).withColumn("_n", true)
    held = materialise(listed.where("_n > 0").withColumn("_row", F.monotonically_increasing_id()), "with-entities")
    raw = held.select("_row", F.posexplode("_found").alias("pos", "raw")).withColumn("is", F.expr(_kind("raw")))
    atoms = raw.select("_row", "pos", F.posexplode(F.expr(_atoms("raw", "is"))).alias("nth", "atom"))
    atoms = materialise(atoms.select("_row", "pos", "nth", "atom.kind", "atom.part", F.expr(_canon("atom.kind", "atom.part")).alias("canon")), "atoms")
    replaced = "kind NOT IN ('', 'initial')"
    counted = materialise(atoms.where(replaced).groupBy("kind", "canon").agg(F.count("*").alias("n")), "entities")
    # A given name after a title without gender is that of the other places where it stands, if they agree.
    told = counted.where("kind LIKE 'given%'").groupBy("canon", F.expr("right(kind, 3)").alias("script"))
    told = told.agg(F.max(F.expr("kind LIKE 'given_m%'")).alias("m"), F.max(F.expr("kind LIKE 'given_f%'")).alias("f")).where("m <> f")
    told = told.selectExpr("canon", "concat('given_u_', script) AS kind", "concat('given_', IF(m, 'm', 'f'), '_', script) AS as_kind")
    known = materialise(counted.join(told, ["kind", "canon"], "left").withColumn("as_kind", F.coalesce("as_kind", "kind")), "entities")
    drawn = draw(known.where("kind = as_kind").select("kind", "canon"), key).withColumnRenamed("kind", "as_kind")
    surrogates = materialise(known.join(drawn, ["as_kind", "canon"]).select("kind", "canon", "n", "surrogate"), "surrogates")
    written = join_counted(atoms.where(replaced), surrogates, ["kind", "canon"]).select("_row", "pos", "nth", "kind", "part", "surrogate")
    kept = atoms.where(f"NOT ({replaced})").select("_row", "pos", "nth", "kind", "part", F.lit(None).cast("string").alias("surrogate"))
    out = f"CASE WHEN kind = 'initial' THEN {_initial('part', key)} ELSE {_layout('kind', 'part', 'surrogate')} END"
    bare = f"lower(regexp_replace(part, {_sql(_OWNER)}, ''))"
    name = f"CASE WHEN kind LIKE 'given%' OR kind LIKE 'family%' THEN struct({bare} AS part, surrogate AS name) END"
    written = written.unionByName(kept).select("_row", "pos", F.struct("nth", F.expr(out).alias("out")).alias("atom"), F.expr(name).alias("name"))
    by_place = written.groupBy("_row", "pos").agg(F.sort_array(F.collect_list("atom")).alias("atoms"), F.collect_list("name").alias("names"))
    by_place = by_place.select("_row", F.struct("pos", F.expr("array_join(transform(atoms, a -> a.out), '')").alias("out")).alias("place"), "names")
    by_row = by_place.groupBy("_row").agg(F.sort_array(F.collect_list("place")).alias("_places"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("_named"))
    joined = held.join(by_row, "_row").withColumn("_between", F.split("_text", PATTERN, -1))
    # Names in the rest of their document, but for those that are also words in small letters there.  Arrays that a
    # lambda looks into are bound by a transform of one element first: Spark would work them out for each call.
    plain = f"IF(size(_named) = 0, array(), array_distinct(flatten(transform(_between, b -> regexp_extract_all(b, {_sql(_WORD)}, 0)))))"
    joined = joined.withColumn("_named", F.expr(f"transform(array({plain}), p -> IF(size(p) = 0, _named, filter(_named, a -> NOT array_contains(p, a.part))))[0]"))
    bound = "struct(_between AS between, _places AS places, transform(_named, a -> a.part) AS parts, transform(_named, a -> a.name) AS names)"
    whole = f"array_join(zip_with(d.between, d.places, (b, p) -> concat(IF(size(d.parts) = 0, b, {_renamed('b', 'd.parts', 'd.names')}), coalesce(p.out, ''))), '')"
    new = F.expr(f"transform(array({bound}), d -> {whole})[0]")
    out = joined.select(*(new.alias(c) if c == "text" else F.col(a).alias(c) for c, a in kept_as.items()), F.col("_n").alias("n_entities"))
    rest = listed.where("_n = 0").select(*(F.col(a).alias(c) for c, a in kept_as.items()), F.lit(0).cast("long").alias("n_entities"))
    return rest.unionByName(out)
