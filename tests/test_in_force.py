"""Revoked resolutions against a walk along their chains, and Czech stems against published examples."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from docloom.functions import czech
from docloom.operators import in_force as I

#: Words and stems in the stemmer's published tests.
STEMS = {
    "pán": "pán", "páni": "pán", "pánové": "pán", "pána": "pán", "pánů": "pán", "pánovi": "pán", "pánům": "pán", "pány": "pán", "pánem": "pán", "pánech": "pán",
    "hrad": "hrad", "hradu": "hrad", "hradem": "hrad", "hrady": "hrad", "hradech": "hrad", "hradům": "hrad",
    "muž": "muh", "muži": "muh", "muže": "muh", "mužů": "muh", "mužem": "muh", "mužích": "muh",
    "žena": "žn", "ženy": "žn", "žen": "žn", "ženě": "žn", "ženám": "žn",
    "město": "měst", "města": "měst", "městu": "měst", "městům": "měst", "městech": "měst",
    "karlův": "karl", "karlova": "karl", "janin": "janin", "český": "česk", "čeští": "česk", "česká": "česk",
    "kniha": "knih", "knize": "knih", "praha": "prah", "praze": "prah", "e": "e", "zi": "zi",
}


def test_stems(spark):
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", czech.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: czech.stemmed(w) for w in STEMS} == STEMS


def walk(rows, revoker, day):
    """Whether each is in force: the states of its chain from the far end."""

    def state(i):
        return rows[i] <= day and not (i in revoker and state(revoker[i]))

    return {i for i in rows if state(i)}


def test_chains_of_revocations(spark):
    r = random.Random(8)
    days = {i: date(2020, 1, 1) + timedelta(days=r.randrange(400)) for i in range(300)}
    order = sorted(days, key=lambda i: (days[i], i))
    named = {}
    for at, i in enumerate(order):
        if at and r.random() < 0.7:
            named[i] = order[max(0, at - r.randrange(1, 6))]  # long chains, and several that name the same
    title = lambda i: f"K revokaci usnesení Rady HMP č. {named[i]} ze dne {days[named[i]].day}. {days[named[i]].month}. {days[named[i]].year}, k návrhu" if i in named else "O věci č. 5"
    rows = spark.createDataFrame([(i, "RV", str(i), days[i], title(i)) for i in days], "id int, body string, number string, date date, title string")
    edges = I.references(rows)
    revoker = {}
    for i in order:
        if i in named and (days[i], i) > (days[named[i]], named[i]):
            revoker.setdefault(named[i], i)
    assert {(e["revoked"], e["revoker"]) for e in edges.filter("counts").collect()} == set(revoker.items())
    assert edges.count() == len(named)
    chain = {i: 0 for i in days}
    for i in reversed(order):
        chain[i] = 1 + chain[revoker[i]] if i in revoker else 0
    assert max(chain.values()) >= 6
    valid = I.validity(rows, edges).cache()
    for day in (date(2019, 12, 31), date(2020, 1, 20), date(2020, 5, 1), date(2020, 9, 9), date(2021, 12, 1)):
        assert {x["id"] for x in I.in_force(valid, F.lit(day)).collect()} == walk(days, revoker, day)
    warned = {x["id"]: x["warning"] for x in I.with_warning(rows, valid, F.lit(date(2020, 9, 9))).collect()}
    now = walk(days, revoker, date(2020, 9, 9))
    assert all((warned[i] is None) == (i in now) for i in days)
    assert all(warned[i] == "Dosud neplatné" for i in days if days[i] > date(2020, 9, 9)) and any((w or "").startswith("Neplatné od ") for w in warned.values())


def test_references_in_their_forms(spark):
    rows = [
        ("a", "RV", "10/2011", date(2011, 6, 27), "Změna sídla strany", "*Toto usnesení bylo zrušeno usnesením republikového výboru [RV 17/2013](http://x)*"),
        ("b", "RV", "17/2013", date(2013, 3, 1), "Sídlo", None),
        ("c", "RHMP", "931", date(2019, 5, 13), "k návrhu", None),
        ("d", "RHMP", "1001", date(2019, 5, 20), "k revokaci usnesení Rady HMP č. 931 ze dne 13. 5. 2019 k návrhu", None),
        ("e", "RV", "931", date(2019, 5, 13), "stejné číslo, jiný orgán", None),
        ("f", "RHMP", "1002", date(2019, 5, 21), "k revokaci usnesení Rady HMP č. 931 ze dne 14. 5. 2019 (jiný den)", None),
        ("g", "RHMP", "900", date(2019, 5, 1), "k revokaci usnesení č. 931", None),
        ("h", None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "id string, body string, number string, date date, title string, note string")
    edges = {(e["revoker"], e["revoked"], e["counts"]) for e in I.references(table, note="note").collect()}
    assert edges == {("b", "a", True), ("d", "c", True), ("g", "c", False)}
    valid = {(v["id"], str(v["since"]), str(v["until"])) for v in I.validity(table, I.references(table, note="note")).collect()}
    assert valid >= {("a", "2011-06-27", "2013-03-01"), ("c", "2019-05-13", "2019-05-20"), ("d", "2019-05-20", "None")} and len(valid) == 7
    assert I.validity(table.limit(0), I.references(table.limit(0))).count() == 0
