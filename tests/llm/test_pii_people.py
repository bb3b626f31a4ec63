"""People of several given names, one person under several titles, domains kept apart, and columns of clashing names."""

import re

from gatewell.llm import pii


def test_all_of_a_long_name_goes(spark):
    rows = [(1, "Mrs. Mary Ann Jones, later Jones and Ann."), (2, "Mr. Alan Turing met Dr. Alan Turing; Alan Turing left."), (3, "Frau Anna Maria Luise Schmidt kam. Schmidt ging."), (4, "Dr. Kim Lee, Ms. Kim Lee and Prof. Kim Lee")]
    out = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k")[0].collect()}
    a = re.fullmatch(r"Mrs\. (\w+) (\w+) (\w+), later (\w+) and (\w+)\.", out[1])
    assert (a[4], a[5]) == (a[3], a[2]) and not {"Mary", "Ann", "Jones"} & set(a.groups()) and len({a[1], a[2], a[3]}) == 3
    b = re.fullmatch(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+); (\w+) (\w+) left\.", out[2])
    assert b[1] == b[3] == b[5] and b[2] == b[4] == b[6] and not {"Alan", "Turing"} & set(b.groups())
    c = re.fullmatch(r"Frau (\w+) (\w+) (\w+) (\w+) kam\. (\w+) ging\.", out[3])
    assert c[4] == c[5] and not {"Anna", "Maria", "Luise", "Schmidt"} & set(c.groups())
    d = re.fullmatch(r"Dr\. (\w+) (\w+), Ms\. (\w+) (\w+) and Prof\. (\w+) (\w+)", out[4])
    assert d[1] == d[3] == d[5] and d[1].endswith("a") and d[2] == d[4] == d[6]


def test_domains_stay_apart(spark):
    n = 1500
    docs = spark.createDataFrame([(i, f"x@d{i}.com y@d{i}.com") for i in range(n)], "doc_id long, text string")
    out, mapping = pii.replace_pii(docs, "k")
    hosts = [re.findall(r"@(\S+)", r.text) for r in out.collect()]
    assert all(a == b for a, b in hosts) and len({a for a, _ in hosts}) == n
    found = mapping.collect()
    assert len({r.new for r in found}) == len(found) == 2 * n


def test_names_of_all_kinds_are_told_apart(spark):
    entities = spark.createDataFrame([(k, f"n{i}", 1) for k in ("name", "given_f", "given_m") for i in range(2000)], "kind string, norm string, n long")
    found = pii.assign(entities, "k").collect()
    families, given = ({r.norm: r.new for r in found if r.kind.startswith(k)} for k in ("name", "given"))
    assert len(found) == 6000 and len({*families.values(), *given.values()}) == 4000


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "Mr. Smith", 1, 2, 3, 4, 5), (2, "none", 1, 2, 3, 4, 5), (None, None, 1, 2, 3, 4, 5)], "doc_id long, text string, __row int, __new int, __names int, i int, `a.b` int")
    out = pii.replace_pii(docs, "k")[0]
    assert out.columns == [*docs.columns, "__n"] and {tuple(r)[2:7] for r in out.collect()} == {(1, 2, 3, 4, 5)}
    assert pii.replace_pii(docs.limit(0), "k")[0].count() == 0
