import re

from tidelog.llm import surrogates
from tidelog.llm.scratch import ship


def test_long_names_initials_and_later_mentions(spark):
    ship(spark)
    text = "Dr. Anna Maria Weber met Mr. J. Smith and Frau K.L. Braun.  Later Anna Weber wrote; Smith's reply, WEBER said.  The will. Mr. Will Lang: Will and Lang"
    rows = surrogates.replace_entities(spark.createDataFrame([(1, text), (2, "Anna Weber and Smith, no title")], "doc_id int, text string"), "a key").collect()
    new = {r.doc_id: r.text for r in rows}
    for real in ["Anna", "Maria", "Weber", "Smith", "Braun", "WEBER", "J. ", "K.L.", "Lang"]:
        assert real not in new[1], real
    m = re.match(r"Dr\. (\w+) (\w+) (\w+) met Mr\. [A-Z]\. (\w+) and Frau [A-Z]\.[A-Z]\. \w+\.  Later (\w+) (\w+) wrote; (\w+)'s reply, (\w+) said\.  The will\. Mr\. \w+ (\w+): Will and (\w+)$", new[1])
    assert m and (m[1], m[3]) == (m[5], m[6]) and m[4] == m[7] and m[8] == m[3].upper() and m[9] == m[10] and len({m[1], m[2], m[3], m[4]}) == 4
    assert new[2] == "Anna Weber and Smith, no title"


def test_addresses_beyond_their_network(spark):
    """More than half of 192.168: there aren't as many free addresses in it."""
    ship(spark)
    found = spark.range(40_000).selectExpr("'ip' AS kind", "concat('192.168.', id div 256, '.', id % 256) AS canon")
    got = [r.surrogate for r in surrogates.draw(found, "a key").collect()]
    real = {f"192.168.{k // 256}.{k % 256}" for k in range(40_000)}
    assert len(set(got)) == 40_000 and not real & set(got) and all(re.fullmatch(r"(192\.168|10\.\d+)\.\d+\.\d+", g) for g in got)
