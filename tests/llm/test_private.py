import random
import hashlib
import re
import time

import pytest

import numpy as np

from cloudloom.llm import private
from cloudloom.llm.queries import op6_private_data

TEXTS = [
    "mail jo.doe@mail5.example.com or jo (at) example (dot) org, call +1 (323) 555-9830. Tel 323 555 9830",
    "host 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5 x",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 1234567890123456789012345",
    "é 💡 a@b.c +49 30 1234567 +1 2",
    "@ a@b @x.y .@-.- a@b..c",
    "+1(2)3.4-5 678 +12345678901234567890",
    "no numbers here",
    "",
    None,
    "123 " * 3000 + "x@y.zz",
    "4111111111111111" * 2,
]


def brute(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card" and (not 16 <= len(digits) <= 19 or sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])) % 10):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_query_equals_brute_force_on_base_spans(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op6_private_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        base, r = brute(t), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in private.KINDS]
        assert set(base) <= set(r.spans.split(","))


def test_em_finds_the_good_labelers():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.4
    right = [0.95, 0.9, 0.85, 0.55]
    votes = np.stack([np.where(rng.random(len(y)) < r, np.where(y, 1, -1), np.where(y, -1, 1)) for r in right], axis=1)
    sure, table, share = private.reliabilities(votes, np.ones(len(y)))
    assert abs(share - 0.4) < 0.02
    for j, r in enumerate(right):
        assert abs(table[1, j, 2] - r) < 0.03
    assert ((sure > 0.5) == y).mean() > 0.95


def test_mask(spark):
    docs = spark.createDataFrame([(1, "to a@b.c, +49 30 1234567!", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, start int")
    model = private.fit(docs)
    got = {r.doc_id: r.text for r in private.mask(docs, model).collect()}
    assert got == {1: "to [EMAIL], [PHONE]!", 2: None, 3: ""}
    assert private.find_private(docs.limit(0), model).collect() == []
    assert private.fit(docs.limit(0)) == {}


def test_numbers_that_run_into_others_are_added():
    text = "7536784127813050 4845168114407329 and +1 (826) 555-4081 190.137.223.204 end"
    model = {p: True for *_, strict, p in private.candidates(text)}
    base, every = private.spans(text, model)
    assert base == [("ip", 56, 71)]
    assert ("card", 17, 33) in every and ("phone", 38, 55) in every


def test_linear_patterns_find_what_the_plain_ones_do():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("aB1.2_@-% ", [3, 1, 3, 4, 2, 1, 3, 1, 1, 1], k=40))
        for kind in private.LINEAR:
            assert [m.span() for m in private.base_matches(kind, text)] == [m.span() for m in private.BASE[kind].finditer(text)], text


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000 + " x@y", "1." * 400_000, "+1" + " " * 1_000_000, "a@" * 300_000, "x@y.z" * 100_000 + "@1"])
def test_long_runs_take_linear_time(text):
    start = time.perf_counter()
    list(private.candidates(text))
    assert time.perf_counter() - start < 20
