import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchframe.llm import infill
from tests.llm.helpers import documents, none, odd

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in row)


def check(docs, **options):
    got = sorted((tuple(r) for r in infill.fill_in_middle(docs, **options).collect()), key=key)
    assert got == sorted((brute(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=key)
    return got


def test_documents_equal_brute_force(spark):
    docs = documents(spark)
    got = check(docs)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    for block in (1, 7):
        check(docs.where("length(text) < 3000"), block_bytes=block)


def test_odd_rows(spark):
    check(odd(spark))
    check(none(spark))
    clash = odd(spark).withColumns({c: F.lit(1) for c in ("form", "first", "units", "output", "n", "prefix_bytes")})
    check(clash)
    # Ids 0 to 99 bring all forms; markers, halves of markers at the cuts, and white space of all kinds.
    texts = ["a <P> b c", "x <M>", "< < < <S <P S> P> M> > <", "  lead and trail \n\t", " ", "\x1c \x85 a", "é🙂 日本 \r\n語", "a", "<S" * 50 + " " + "P>" * 50]
    rows = [(i, t) for i in range(100) for t in texts]
    check(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=5)


def test_every_text_comes_back(spark):
    docs = documents(spark).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    out = infill.fill_in_middle(docs).withColumn("back", infill.restored())
    assert sorted((r["doc_id"] or -1, r["back"]) for r in out.collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())


@pytest.mark.parametrize("blocks", [1, 2, 3, 8, 13, 64, 100])
def test_tree_equals_running_sums(blocks):
    counts = np.random.default_rng(blocks).integers(0, 4, (blocks, 2))
    tree, sums = infill.Fenwick(counts), np.vstack([[0, 0], counts.cumsum(axis=0)])
    assert all((tree.below(i) == sums[i]).all() for i in range(blocks + 1))
    for k in range(1, int(sums[-1, 0]) + 1):
        block, before = tree.find(k)
        assert sums[block, 0] < k <= sums[block + 1, 0] and (before == sums[block]).all()
