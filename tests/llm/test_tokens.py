import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomseq.llm import queries
from loomseq.llm.encoding import encoder
from loomseq.llm.media import decode_media, documents_as_media, encode_media, interleave, parse_html, payload_of, resolve
from loomseq.llm.packing import assign, differencing, pack
from loomseq.llm.token_store import Shard, build_mph, find_slots, key_hash, shard_bytes, store

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    return Tokenizer.from_file(path)


def ids_of(path, texts):
    ids, at = encoder(path).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_documents(spark, sf, path):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    t = library(path)
    assert ids_of(path, texts) == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t.,'\u00a0\u2003\u3000\x1c\x1f\x01<|>AbÉé1٣日ß\u0130\u0301"), st.characters(exclude_categories=["Cs"])), max_size=25), max_size=4))
def test_encoder_on_any_text(texts):
    for path in (BYTE, WORD):
        t = library(path)
        assert ids_of(path, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


#: Letters that change under case or composition, marks, digits, odd white space and punctuation.
ODD = " \n\t.,'-_<|>Ab1\u00a0\u2003\u3000\x1c\x1f\x01\u0301\u0307\u0345\u0130\u0131\u00c9\u00df\u1e9e\u03a3\u03c2\u0390\u1fbc\u01c5\ufb01\u0149\u01f0\u212a\u212b\u0958\u0663\u1100\u1161\u11a8\uac00\u65e5\U00010400\U0001d7ce\u200d\u0e33"


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_many_random_texts(path):
    rng = np.random.default_rng(5)
    lens = rng.integers(1, 10, 100_000)
    letters = np.array(list(ODD))[rng.integers(0, len(ODD), int(lens.sum()))]
    ends = np.cumsum(lens)
    short = ["".join(letters[b - n : b]) for b, n in zip(ends, lens, strict=True)]
    texts = short[:5000] + ["\n".join(short[k : k + 100]) for k in range(5000, len(short), 100)]
    assert ids_of(path, texts) == [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_every_character(path):
    import unicodedata

    known = [f"a{c}b {c}.,{c}" for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    texts = ["\n".join(known[k : k + 100]) for k in range(0, len(known), 100)]
    assert ids_of(path, texts) == [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["\u0130,", "DEVLET\u0130.", "a\u0130,,b", "\u0958.", "<|endoftext|>", "a <|startoftext|>b", "it's we'll  they'RE", "x.,.,y", "été.,", "\u200b a", "e\u0301 \u0301x", "<|endoftext|", "1.5,2"])
def test_encoder_on_known_troubles(text):
    for path in (BYTE, WORD):
        assert ids_of(path, [text]) == [library(path).encode(text, add_special_tokens=False).ids]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 150))
def test_assign(sizes, capacity):
    window, k = assign(np.array(sizes, np.int64), capacity)
    loads = np.bincount(window, weights=sizes, minlength=k) if sizes else np.zeros(k)
    assert len(loads) == k and loads.max() <= capacity


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 500, 400)
    loads = np.bincount(differencing(sizes, 32), weights=sizes, minlength=32)
    assert loads.sum() == sizes.sum() and loads.max() - loads.min() < 20
    assert sorted(np.bincount(differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4]).tolist()) == [14, 16]


def check_packing(rows, texts, capacity=2048):
    t = library(WORD)
    whole = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == whole.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole[i]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(whole[i][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(whole[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and {r["sequence_length"] for r in own} == {at}
    return len(sequences)


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pack(docs.coalesce(1)).collect()
    n = check_packing(rows, texts)
    assert n * 2048 <= 1.03 * sum(r["length"] for r in rows) + 2048


def test_many_tiny_texts_stay_bounded(spark):
    rows = pack(spark.range(40_000).selectExpr("id as doc_id", "cast(null as string) as text").coalesce(1)).collect()
    assert check_packing(rows, dict.fromkeys(range(40_000))) <= 40_000 // 2048 + 3


def test_packing_odd(spark, odd, nothing):
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(pack(unique).collect(), {r["doc_id"]: r["text"] for r in unique.collect()})
    assert pack(nothing).count() == 0 and pack(odd).groupBy("doc_id", "start").count().count() > 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_perfect_hash(n):
    ids = np.arange(n, dtype=np.int64) * 977 - 5
    h = key_hash(ids, np.zeros(n, bool), np.zeros(n, np.int64))
    seeds, slots = build_mph(h)
    assert sorted(slots) == list(range(n)) and (find_slots(h, seeds, n) == slots).all()


def test_shard_lookup():
    ids = [np.arange(k, dtype=np.uint32) + k for k in (1, 5, 2, 3)]
    s = Shard(b"".join(shard_bytes([7, None, 7, -3], np.array([1, 5, 2, 3]), ids, False)))
    assert s.get(7).tolist() == ids[0].tolist() and s.get(None).tolist() == ids[1].tolist() and s.get(7, 1).tolist() == ids[2].tolist() and s.get(-3).tolist() == ids[3].tolist()
    assert sum(s.get(k) is not None for k in range(100, 400)) <= 1
    with pytest.raises(ValueError):
        Shard(b"nonsense" * 4)


@pytest.mark.parametrize("shard_ids", [1 << 24, 5000])
def test_store(spark, sf, shard_ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    t, at = library(BYTE), 0
    want = []
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = store(docs.repartition(5), shard_ids=shard_ids).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_store_odd(odd, nothing):
    got = store(odd).orderBy("start").collect()
    assert len(got) == odd.count() and store(nothing).count() == 0
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_media(spark, odd, nothing):
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = documents_as_media(odd).collect()
    assert len(got) == len(texts) and documents_as_media(nothing).count() == 0

    def want(i, t):
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        m = encode_media(p)
        return i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()

    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted((want(i, t) for i, t in texts), key=repr)
    lines = {}
    for i, t in texts:  # the reference stands after all lines that aren't blank, with its caption
        lines.setdefault(i, set()).add(sum(bool(x.split()) for x in (t or "").split("\n")))
    assert all(r["pos"] in lines[r["doc_id"]] and r["caption"] == ("null" if r["doc_id"] is None else str(r["doc_id"])) for r in got)
    features = {}
    for r in got:
        features.setdefault((r["payload_sha256"], r["n_bytes"]), set()).add(r["feature"])
    assert all(len(f) == 1 for f in features.values())


@given(st.binary(max_size=300))
def test_media_round_trip(raw):
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    assert decode_media(encode_media(payload)) == payload
    text = raw.decode("latin-1")
    assert payload_of(text)[0].rstrip(b"\0") == text.encode().rstrip(b"\0")


def test_store_forgets(spark, monkeypatch):
    from loomseq.llm import media

    monkeypatch.setattr(media, "REMEMBER", 3)
    import pyarrow as pa

    texts = [f"t{i % 5}" for i in range(20)]
    kept = [r for b in media._store([pa.RecordBatch.from_pydict({"text": texts})]) for r in b.column("digest").to_pylist()]
    assert len(set(kept)) == 5 and len(kept) > 5


def test_pages_as_sequences(spark, sf):
    """Real pages: every item in order, images with their captions; the text of all items is the page's visible text."""
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = interleave(pages).collect()
    assert len(got) == len(html)
    for r in got:
        items = r["items"]
        assert [x["pos"] for x in items] == list(range(len(items)))
        visible = re.sub(r"(?s)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1>", "", html[r["page_id"]] or "")
        assert [x["ref"] for x in items if x["kind"] == "media"] == re.findall(r"<(?:img|video|audio|source|embed)\b[^>]*?\bsrc=[\"']([^\"']+)", visible)
        assert all(x["text"] and "<p" not in x["text"] for x in items if x["kind"] == "text")
    first = [(r["page_id"], "known" if i % 2 else "not") for i, r in enumerate(got)]
    mixed = spark.createDataFrame([(p, f'<p>before</p><img src="sha256:{d}" alt="of {p}">{html[p] or ""}') for p, d in first], "page_id long, html string")
    resolved = resolve(interleave(mixed), spark.createDataFrame([("known", 5)], "digest string, size long"))
    assert resolved.count() == sum(len(parse_html(f'<p>before</p><img src="x">{h or ""}')) for h in html.values())
    for r in resolved.where("digest is not null").collect():
        assert (r["pos"], r["caption"], r["size"]) == (1, f"of {r['page_id']}", 5 if r["digest"] == "known" else None)


def test_interleaving(spark):
    html = '<p>Hello <b>you</b></p><img src="sha256:aa" alt="one"><figure><img src="sha256:bb"><figcaption>cap tion</figcaption></figure><script>no</script>tail'
    items = [(x["pos"], x["kind"], x["text"], x["ref"], x["caption"]) for x in parse_html(html)]
    assert items == [(0, "text", "Hello you", None, None), (1, "media", None, "sha256:aa", "one"), (2, "media", None, "sha256:bb", "cap tion"), (3, "text", "tail", None, None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p"), (1, html)], "page_id long, html string")
    payloads = spark.createDataFrame([("bb", b"x", "clash")], "digest string, payload binary, other string")
    got = resolve(interleave(pages), payloads).orderBy("page_id", "pos").collect()
    assert [(r["pos"], r["payload"]) for r in got if r["page_id"] == 1] == [(p, bytearray(b"x") if p == 2 else None) for p in (0, 0, 1, 1, 2, 2, 3, 3)]
    assert queries.QUERIES["op7_media"]
