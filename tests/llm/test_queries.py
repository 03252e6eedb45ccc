"""The registered queries op1 to op10 on the smallest tables: against SQL, or against brute force and held-out labels."""

import collections
import hashlib
import zlib
from array import array
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from kymo.llm import bpe, queries

from .test_dedup import near_brute
from .test_toxicity_pipeline import auc

TABLES = Path("/root/testdata/sf0.001")
LARGER = Path("/root/testdata/sf0.1")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the synthetic tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows_of(spark, name):
    return queries.queries()[name](spark, str(TABLES)).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = rows_of(spark, name)
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(found.fetchall(), key=repr)
    assert sorted(got[0].asDict()) == sorted(names)


def test_bpe(spark, duck):
    library = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for key, text in duck.execute("select doc_id, text from documents").fetchall():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((key, len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, "op1_bpe")} == want


def test_shuffle(spark, duck):
    got = rows_of(spark, "op2_shuffle")
    texts = duck.execute("select doc_id, text from documents").fetchall()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_simhash(spark, duck):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op5_simhash")), key=repr) == near_brute(rows)


def test_toxicity(spark, duck):
    labels = dict(duck.execute("select doc_id, toxic from labels").fetchall())
    got = rows_of(spark, "op8_toxicity")
    assert len(got) == duck.execute("select count(*) from documents").fetchall()[0][0]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    y = np.array([labels[r["doc_id"]] for r in held])
    if 0 < y.sum() < len(y):
        assert auc(np.array([r["score"] for r in held]), y) > 0.5


@pytest.mark.skipif(not LARGER.exists(), reason="the synthetic tables aren't here")
def test_toxicity_of_held_out_documents(spark):
    labels = dict(duckdb.sql(f"select doc_id, max(toxic) from '{LARGER}/labels.parquet' where toxic is not null group by 1").fetchall())
    held = [r for r in queries.op8_toxicity(spark, str(LARGER)).filter("held_out").collect() if r["doc_id"] in labels]
    y, said = np.array([labels[r["doc_id"]] for r in held]), np.array([r["predicted"] for r in held])
    assert auc(np.array([r["score"] for r in held]), y) > 0.95
    hit = (said * y).sum()
    assert hit / said.sum() > 0.9 and hit / y.sum() > 0.85


def test_main_text(spark, duck):
    import html
    import re

    for r, (page,) in zip(sorted(rows_of(spark, "op10_html"), key=lambda r: r["page_id"]), duck.execute("select html from pages order by page_id").fetchall()):
        inside = re.search(r"(?s)<article>(.*)</article>", page)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
