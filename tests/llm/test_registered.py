"""The registered queries without SQL, on a whole table, against plain Python."""

import hashlib
import os
import zlib

import pytest

from docloom.llm import licences, packing, queries
from test_licences import brute as licence_brute
from test_pii import brute as pii_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
sha = lambda data: hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    got = rows(spark, "op1_media_ogg")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        data = texts[r["doc_id"]].encode()
        whole = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), sha(whole), zlib.crc32(whole[-64:]))
        assert r["media_bytes"] > len(whole) and len(r["media_sha256"]) == 64 and "bad=0" in r["feature"]


def test_op2(spark, texts):
    got, bins, words = rows(spark, "op2_best_fit_packing"), {}, {}
    for r in got:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
        if r["n_words"]:
            bins.setdefault(r["bin_id"], []).append((r["offset"], r["n_words"], r["capacity"]))
    assert words == {i: len(t.encode().split()) for i, t in texts.items()}
    for parts in bins.values():
        used = 0
        for offset, size, _ in sorted(parts):
            assert offset == used
            used += size
        assert {c for *_, c in parts} == {min(c for c in packing.LENGTHS if c >= used)}


def test_op6(spark, texts):
    got = rows(spark, "op6_piece_sampling")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode()) and r["n_samples"] == len(r["inclusion"]) <= 2


def test_op8(spark, texts):
    for r in rows(spark, "op8_pii"):
        base = pii_brute(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode())
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r["spans"].split(",")) | {""}


def test_op10(spark, texts):
    for r in rows(spark, "op10_licence_scan"):
        units = licence_brute(texts[r["doc_id"]])
        assert r["n_matches"] >= len(units) and {u[0] for u in units} <= set((r["licences"] or "").split(","))
        if units:
            assert r["dice"] >= round(max(u[2] for u in units), 6) >= licences.THRESHOLD - 1e-9


def test_op9_keeps_every_message(spark):
    messages = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").collect()
    got = rows(spark, "op9_quote_links")
    assert sorted((r["conv_id"], r["turn"]) for r in got) == sorted(map(tuple, messages))
