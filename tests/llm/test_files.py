"""Archives, packing and chat formatting: round trips, brute force, and the defined cases. The pipeline."""

import gzip
import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from outcomelake.llm import chat, packing, skew, warc
from outcomelake.sources.storage import new_path

BIG = "<p>" + "x" * 1200 + "é</p>"
PAGES = [(1, "http://b/", BIG), (2, "http://a/", BIG), (3, None, BIG), (4, "http://c/\r\nX: y", "small"), (5, "http://c/", "small"), (6, "http://d/", None), (7, "http://e/", ""), (None, "http://f/", BIG), (9, "http://g/", BIG + "!"), (8, "http://h/", "y" * 300_000)]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


def files_of(folder):
    import glob

    return {p.rsplit("/", 1)[1]: open(p, "rb").read() for p in sorted(glob.glob(folder.removeprefix("file:") + "/*.warc.gz"))}


def test_archives_round_trip(spark):
    folder = new_path(spark, "warc-test")
    manifest = warc.write_archives(pages_of(spark, PAGES), folder, shard_bytes=2000, roll_bytes=1000)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()}
    want = {}
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        revisit = html == BIG and page_id != 3
        want[page_id] = (len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)
    assert got == want
    files, listed = files_of(folder), {r.name: r for r in manifest.collect()}
    assert set(files) == set(listed) and len(files) > 1 and all(len(b) == listed[n].bytes and hashlib.sha1(b).hexdigest() == listed[n].sha1 for n, b in files.items())
    assert sum(r.records for r in listed.values()) == len(PAGES) + len(files)
    assert all(gzip.decompress(b).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") for b in files.values())


def test_archives_do_not_depend_on_partitions(spark):
    seen = []
    for parts in (1, 5):
        folder = new_path(spark, "warc-test")
        warc.write_archives(pages_of(spark, PAGES).repartition(parts), folder, shard_bytes=2000)
        seen.append(files_of(folder))
    assert seen[0] == seen[1]


def test_archive_sorting_and_ties(spark):
    rows = [(1, "http://a/", BIG), (1, "http://a/", BIG), (2, "http://a/", "z" * 10)]
    folder = new_path(spark, "warc-test")
    warc.write_archives(pages_of(spark, rows), folder)
    got = sorted((r.position, r.page_id, r.record_type) for r in warc.read_archives(spark, folder).collect())
    assert [g[1:] for g in got] == [(1, "response"), (1, "response"), (2, "response")]
    empty = new_path(spark, "warc-test")
    assert warc.write_archives(pages_of(spark, rows).limit(0), empty).count() == 0 and warc.read_archives(spark, empty).count() == 0


def test_damage_is_found(spark):
    folder = new_path(spark, "warc-test")
    warc.write_archives(pages_of(spark, PAGES), folder)
    path = next(iter(files_of(folder)))
    full = f"{folder.removeprefix('file:')}/{path}"
    records = gzip.decompress(open(full, "rb").read()).replace(b"small", b"smell")
    open(full, "wb").write(gzip.compress(records))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, folder).collect()


ENCODER, PLAIN = packing.TextEncoder(*packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer()[0])


def whole_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-7, "a <|endoftext|> b"), (-8, "<|endoftext|>\n<|endoftext|><|endoftext|> x"), (-9, "x<|endoftext|>.\nnext <|endo ftext|>"), (-1, ""), (-2, None), (-3, " double  space\n\n and\ttabs "), (-4, "w" * 50_000), (-5, "it's 3.5 <|endoftext|> ok"), (None, "no id"), (-6, "\u00a0x \u3000 y")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = packing.pack(rows, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    totals = got.groupby("sequence_id").length.sum()
    assert totals.max() <= 1024 and len(totals) <= 1.02 * -(-got.length.sum() // 1024)
    by_doc = {None if k != k else k: g.sort_values("piece") for k, g in got.groupby("doc_id", dropna=False)}
    for doc_id, text in [tuple(r) for r in rows.collect()]:
        own, want = by_doc[doc_id], np.array(whole_ids(text), "<u4")
        assert b"".join(own.ids) == want.tobytes() and own.piece.tolist() == list(range(len(own)))
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and (own.length.iloc[1:] == 1024).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(b) for b in own.ids]
    assert packing.pack(rows.limit(0)).count() == 0


@given(st.lists(st.sampled_from(["<|endoftext|>", "the", " ", "  ", "\n", "\t", ".", ",", "x1", "é", "<", "|", ">", "'s", "\u4f60", "\u3000", "\u0301", "\U0001f600"]), max_size=14).map("".join) | st.text(max_size=30))
@settings(max_examples=1500, deadline=None)
def test_ids_by_ranks_equal_the_plain_call(text):
    assert ENCODER.ids(text) == np.asarray(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_cases(spark):
    """Repeated rows, clashing columns, ties of length, and a tokenizer without ranks."""
    rows = [(1, "a b", "clash", 0), (1, "a b", "clash", 0), (None, None, "clash", 0), (2, "a b", "clash", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, piece int")
    for path in (None, packing.default_tokenizer()[0]):
        got = packing.pack(docs, tokenizer_path=path, capacity=4)
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        found = sorted((str(r.doc_id), r.length, r.offset) for r in got.collect())
        assert [f[:2] for f in found] == [("1", 3), ("1", 3), ("2", 3), ("None", 1)]
        assert sorted((r.sequence_id, r.offset) for r in got.collect()) == [(0, 0), (0, 3), (1, 0), (2, 0)]


def test_packing_is_nearly_the_best_of_all():
    rng = np.random.default_rng(8)
    for _ in range(5):
        counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 101, 400), return_counts=True), strict=True)}
        patterns = packing.bin_patterns(counts, 100)
        used = {}
        for times, taken in patterns:
            assert sum(k * v for k, v in taken.items()) <= 100
            for k, v in taken.items():
                used[k] = used.get(k, 0) + times * v
        # No packing has fewer bins than the total needs; first-fit decreasing is the usual rule to beat.
        rooms = []
        for size in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            at = next((i for i, room in enumerate(rooms) if room >= size), None)
            if at is None:
                rooms.append(100 - size)
            else:
                rooms[at] -= size
        assert used == counts and -(-sum(k * v for k, v in counts.items()) // 100) <= sum(t for t, _ in patterns) <= len(rooms)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_fullest_is_the_fullest(counts, room):
    items = [k for k, v in counts.items() for _ in range(v)]
    reach = {0}
    for x in items:
        reach |= {r + x for r in reach if r + x <= room}
    taken = packing.fullest(counts, room)
    assert sum(k * v for k, v in taken.items()) == max(reach) and all(v <= counts[k] for k, v in taken.items())


TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a>>\nb\\"]), st.lists(st.sampled_from(list("\\<>[]/INSTs ROLE\n") + ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</ROLE>>", "é"]), max_size=12).map("".join)), max_size=6)


@given(TURNS)
@settings(max_examples=400, deadline=None)
def test_turns_come_back(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [body for role, body in turns if role == "assistant"]


def test_conversations(spark):
    quoted = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é\\n"), (-7, 1, "assistant", quoted), (-7, 0, "user", quoted), (2, None, None, None), (2, 1, "assistant", None), (None, 0, "user", "x"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(table)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        whole, learned = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own), "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"[INST]{t}</s>" * 50) for i in (1, None) for t in range(40)] + [(2, 0, "user", "x" * 100_000), (2, 1, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: str(r.conv_id)
    want = sorted(chat.digests(chat.format_conversations(table)).collect(), key=key)
    monkeypatch.setattr(chat, "PART_CHARS", 3000)
    parts = list(chat._turn_rows(iter([pa.record_batch([pa.array(c) for c in zip(*((r[0] or 0, r[2], r[3]) for r in rows), strict=True)], names=["id", "role", "text"])])))
    assert len(parts) > 10 and [p[1] for p in parts if p[0] == 1] == list(range(sum(p[0] == 1 for p in parts)))
    digest = {}
    for conv_id, part, own in parts:
        text, spans = chat.format_turns(own)
        digest.setdefault(conv_id or None, chat._Digest()).add(text, [{"start": a, "end": b} for a, b in spans])
    assert sorted((d.row(i) for i, d in digest.items()), key=lambda r: str(r[0])) == [tuple(r) for r in want]


def test_layouts(spark):
    plain, parts = [("user", "q"), ("assistant", "a")], [{"type": "text", "text": "q"}, {"type": "image", "url": "u"}, {"type": "text", "text": "r"}]
    cases = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, plain), ({"prompt": "q", "completion": "a"}, plain),
        ({"instruction": "q", "output": "a"}, plain), ({"instruction": "q", "input": "i", "output": "a"}, [("user", "q"), ("user", "i"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, plain), ({"system": "s", "prompt": "q", "response": "a"}, [("system", "s"), *plain]),
        ({"question": "q", "answer": "a"}, plain), ({"unknown": 1}, None), ({"messages": []}, []), ({"messages": ["q"]}, None),
        ({"id": 7, "source": {"name": "web"}, "messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a", "tool_calls": []}]}, plain),
        ({"prompt": "q", "prompt_id": "1", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, plain),
        ({"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": None}]}, [("user", "qr"), ("assistant", "")]),
        ({"system": None, "messages": [{"role": "user", "content": "q"}]}, [("user", "q")]), ({"id": 1, "prompt": "q"}, None), ({"prompt": "q" * 200_000, "completion": "a", "meta": []}, [("user", "q" * 200_000), ("assistant", "a")]),
    ]
    rows = [(i, json.dumps(r), "x", "y") for i, (r, _) in enumerate(cases)] + [(90, None, "x", "y"), (91, "{broken", "x", "y"), (92, "[]", "x", "y"), (1, json.dumps(cases[1][0]), "x", "y"), (None, json.dumps(cases[1][0]), "x", "y")]
    table = spark.createDataFrame(rows, "record_id long, record string, formatted string, layout string")
    found = chat.format_records(table)
    got = [(r.record_id, chat.parse(r.formatted) if r.formatted is not None else None) for r in found.collect()]
    assert found.columns == ["record_id", "layout", "formatted", "loss_spans"]
    want = [*((i, t) for i, (_, t) in enumerate(cases)), (90, None), (91, None), (92, None), (1, plain), (None, plain)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chat.format_records(table.limit(0)).count() == 0


@pytest.mark.parametrize("keys", [100_000, 2])
def test_archive_groups_by_any_join(spark, monkeypatch, keys):
    """Groups that are sent to all tasks and groups that are joined by size; a third of all rows copies, many small and null payloads."""
    monkeypatch.setattr(skew, "BROADCAST_KEYS", keys)
    rows = [(i, f"http://h/{i % 7}", "hot " * 400 if i % 3 == 0 else f"g{i % 20} " * 500 if i % 3 == 1 else (None, "small")[i % 2]) for i in range(150)]
    folder = new_path(spark, "warc-test")
    warc.write_archives(pages_of(spark, rows), folder)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder).collect()}
    last = {}
    for i, _, text in rows:
        last[text] = i
    for i, _, text in rows:
        size = len((text or "").encode())
        want = ("response", None, size) if size < 1000 or last[text] == i else ("revisit", last[text], size)
        assert got[i] == want
