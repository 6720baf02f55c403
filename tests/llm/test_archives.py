"""Chat formatting and web archives: round trips, and digests against plain Python."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from siftwell.llm import chat, warc
from siftwell.llm.queries import QUERIES

from .conftest import SF

TEXTS = st.lists(st.sampled_from([*"\\<[|>]/nN \n\r", "\U0001f600", "é", "[INST]", "</s>"])).map("".join)


@given(TEXTS)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(x in chat.escape(text) for x in ("<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]"))


def plain_chat(rows):
    """rows: (conv_id, turn, role, text) in order."""
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role or "", text or ""))
    out = Counter()
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        out[(c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())] = 1
    return out


def test_chat_query(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_chat([*sorted(rows, key=lambda r: r[:2]), (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = QUERIES["op3_chat_formatting"](spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == want and all(r.formatted_chars > r.loss_chars for r in got)


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "a\\<["), (1, 1, "assistant", "a\\<["), (1, 1, "assistant", "A"), (2**60 + 1, 5, "as\nsistant", ""), (None, 0, "assistant", "x" * 300_000), (None, None, "user", "\n")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = chat.read_back(chat.render(chat.fold(chat.messages(frame)))).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert Counter(tuple(r)[:5] for r in got) == plain_chat(sorted(rows, key=order))
    assert chat.read_back(chat.render(chat.fold(chat.messages(frame.limit(0))))).count() == 0


def plain_fold(events):
    state = {}
    for conv, _, op, turn, role, text in sorted(events, key=lambda e: e[:2]):
        turns = state.setdefault(conv, {})
        if op == "regenerate":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
        if op == "delta" and turn in turns:
            turns[turn] = (turns[turn][0] or role, turns[turn][1] + text)
        else:
            turns[turn] = (role, text)
    return {(c, t, *x) for c, turns in state.items() for t, x in turns.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    r = random.Random(seed)
    ops = ["message", "delta", "delta", "delta", "edit", "regenerate"]
    events = [(c, s, r.choice(ops), r.randrange(4), "assistant", r.choice(["ab", "", "\n<x", "é"])) for c in range(8) for s in range(r.randrange(1, 25))]
    r.shuffle(events)
    frame = spark.createDataFrame(events, "conv_id bigint, seq bigint, op string, turn bigint, role string, text string")
    assert {tuple(x) for x in chat.fold(frame).collect()} == plain_fold(events)
    spans = chat.render(chat.fold(frame)).collect()
    assert all(chat.unescape(x.formatted[x.loss_start : x.loss_end]) == next(t for c, n, _, t in plain_fold(events) if (c, n) == (x.conv_id, x.turn)) for x in spans)


def plain_warc(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = Counter()
    for page, _, html in rows:
        b = (html or "").encode()
        ids = [x for x in groups[b] if x is not None]
        last = max(ids) if ids else None
        ref = last if len(b) >= 1000 and last is not None and page != last else None
        out[(page, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref)] += 1
    return out


def test_archives(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    page = "<p>WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n é\x00</p>" * 40
    odd = [(2**60 + 1, "http://a.example/x", page), (5, "https://www.a.example:8080/x?q=1#f", page), (None, None, page), (7, "not a url\r\nX: y", None), (8, "http://[", ""), (8, "", ""), (9, "", "s" * 999), (10, "", "s" * 999), (11, "http://b.example", "s" * 1000), (11, "http://b.example", "s" * 1000), (12, "x", "l" * 3_000_000)]
    own = spark.createDataFrame([(*r, 1) for r in odd], "page_id bigint, url string, html string, digest int")
    for i, frame in enumerate((table, own)):
        got = warc.capture_histories(frame, f"{tmp_path}/{i}").collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain_warc([tuple(r)[:3] for r in frame.collect()])
        keys = [(r.shard, r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id) for r in got]
        assert [k[1:] for k in sorted(keys)] == sorted(k[1:] for k in keys)
        for r in got[:20]:
            data = gzip.decompress(open(r.file.removeprefix("file:"), "rb").read())
            record = data[r.offset : r.offset + r.length]
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    assert warc.capture_histories(table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_loser_tree(seed):
    r = random.Random(seed)
    runs = [sorted(r.randrange(20) for _ in range(r.randrange(6))) for _ in range(r.randrange(8))]
    assert list(warc.merged_runs(runs)) == sorted(x for run in runs for x in run)
