from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.quotation import link, parse
from quillspark.llm.transport_stream import PACKET, decode, demux, encode, mux, section_crc


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.integers(0, 200_000).map(lambda n: np.random.default_rng(n).bytes(n))))
def test_round_trip(payload):
    media = mux(payload)
    program = demux(media)
    assert program.payload == payload and program.continuity_errors == 0 and len(media) % PACKET == 0
    n = max(1, -(-len(payload) // 32_000))
    assert program.pts == [126_000 + 3_600 * k for k in range(n)] and program.random_access == list(range(0, n, 4))
    assert len(program.clock) == n


def read_by_hand(media: bytes) -> tuple[bytes, list[int]]:
    """Payload and timestamps by the published packet layout, one packet after the other."""
    program_map = stream = None
    units: list[bytearray] = []
    for at in range(0, len(media), 188):
        packet = media[at : at + 188]
        assert packet[0] == 0x47
        start, pid, control = packet[1] >> 6 & 1, (packet[1] & 0x1F) << 8 | packet[2], packet[3] >> 4 & 3
        body = packet[4:] if control == 1 else packet[5 + packet[4] :] if control == 3 else b""
        if pid == 0:
            section = body[1 + body[0] :]
            program_map = (section[10] & 0x1F) << 8 | section[11]
        elif pid == program_map:
            section = body[1 + body[0] :]
            skip = (section[10] & 0xF) << 8 | section[11]
            stream = (section[13 + skip] & 0x1F) << 8 | section[14 + skip]
        elif stream is not None and pid == stream:
            if start:
                units.append(bytearray())
            units[-1] += body
    payload, times = b"", []
    for unit in units:
        assert unit[:3] == b"\0\0\1"
        size, head, p = unit[4] << 8 | unit[5], unit[8], unit[9:14]
        times.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
        payload += bytes(unit[9 + head : 6 + size] if size else unit[9 + head :])
    return payload, times


@pytest.mark.parametrize("n", [0, 1, 64, 183, 184, 185, 31_999, 32_000, 100_001])
def test_an_independent_reader_reads_the_same(n):
    payload = np.random.default_rng(n).bytes(n)
    media = mux(payload)
    assert read_by_hand(media) == (payload, demux(media).pts)


def test_faults():
    media = mux(bytes(70_000))
    lost = media[: 20 * PACKET] + media[21 * PACKET :]
    assert demux(lost).continuity_errors > 0
    for broken in (b"", media[:-1], media[:PACKET] + b"\0" + media[PACKET + 1 :], media[: 2 * PACKET].replace(b"\xe1\x00\xf0", b"\xe1\x01\xf0")):
        with pytest.raises(ValueError):
            demux(broken)
    assert section_crc(b"123456789") == 0x0376E6E7


def test_columns(docs, texts, empty):
    got = decode(encode(docs)).collect()
    assert len(got) == len(texts)
    want = sorted(((t or "").encode() for _, t in texts))
    plain = sorted(bytes(r["payload"])[: r["n_bytes"]] for r in got)
    assert plain == want
    for r in got:
        p = bytes(r["payload"])
        assert r["payload_bytes"] == len(p) > 0 and len(p) % 64 == 0 and not p[r["n_bytes"] :].strip(b"\0")
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:]) and r["continuity_errors"] == 0
    same = {(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert decode(encode(empty)).count() == 0


def test_parse_levels():
    own, quotes = parse("Ann wrote:\n> first\n>> deeper\n> > deeper too\n> back\nmine: said\n\nmore")
    assert own == "mine: said\n\nmore"
    assert quotes == [(1, "first"), (2, "deeper\ndeeper too"), (1, "back")]
    assert parse(None) == ("", []) and parse("5 > 3") == ("5 > 3", [])


def test_attributions_at_every_level():
    own, quotes = parse("On Tue B wrote:\n> B's reply\n> On Mon A wrote:\n>\n>> A's text\n> B's end\nmine")
    assert own == "mine" and quotes == [(1, "B's reply"), (2, "A's text"), (1, "B's end")]


def test_long_texts_parse_in_time_that_grows_with_them():
    began = time.process_time()
    own, quotes = parse("\n" * 300_000 + "> a\nb\n" * 100_000)
    assert len(quotes) == 100_000 and own.count("b") == 100_000 and time.process_time() - began < 10


def test_trimmed_and_nested_quotes_link(spark):
    first = "Opening words of the first message.\nA second line that goes on.\n\nAnother paragraph is here.\n\nThe last one"
    rows = [
        (1, 0, "u", first),
        (1, 1, "a", "> A second line that goes on.\nB's own reply"),
        (1, 2, "u", "something in between"),
        (1, 3, "a", "On Tue B wrote:\n> B's own reply\n> On Mon A wrote:\n>> Another paragraph is here.\n>>\n>> The last one\nC's words"),
        (1, 4, "u", "> Another paragraph is here.\n> with a line that nobody wrote\nend"),
        (1, 5, "u", "> words of nobody\nend"),
    ]
    got = {r["turn"]: r for r in link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {t: (r["reply_to"], r["n_quotes"], r["n_linked"]) for t, r in got.items()} == {0: (None, 0, 0), 1: (1, 1, 1), 2: (2, 0, 0), 3: (2, 2, 2), 4: (1, 1, 1), 5: (5, 1, 0)}


def links_by_hand(rows):
    """The latest earlier message of the conversation with equal text, for each quoted passage: by plain comparison."""
    clean = lambda t: tuple("".join(c if c.isalnum() else " " for c in t.lower()).split())
    out = {}
    for i, (_, own, quotes) in enumerate(rows):
        found = []
        for level, passage in quotes:
            for units in (lambda t: [t], lambda t: t.split("\n\n"), lambda t: [x for x in t.split("\n") if len(clean(x)) >= 4]):
                wanted = {clean(u) for u in units(passage)} - {()}
                holders = [j for j in range(i) if wanted & {clean(u) for u in [rows[j][1], *rows[j][1].split("\n\n"), *rows[j][1].split("\n")]}]
                if holders:
                    found.append((level, max(holders)))
                    break
        out[i] = (min(found, key=lambda x: x[0])[1] + 1 if found else i or None, len(found))
    return out


def test_links_equal_plain_comparison(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice("ab cd ef gh ij kl mn".split()) for _ in range(5)) for _ in range(12)]
    rows = []
    for i in range(60):
        own = "\n".join(r.choice(pool) + r.choice(["", "\n"]) for _ in range(r.randrange(1, 4)))
        quotes = [(level, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 3)))) for level in r.sample([1, 2], r.randrange(3))]
        text = "\n".join([*("\n".join(">" * lv + " " + x for x in q.split("\n")) for lv, q in quotes), own])
        rows.append((text, *parse(text)))
    got = link(spark.createDataFrame([(1, i, "u", t) for i, (t, _, _) in enumerate(rows)], "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {x["turn"]: (x["reply_to"], x["n_linked"]) for x in got} == links_by_hand(rows)


def test_reply_order(spark):
    rows = [
        (1, 0, "u", "Hello there friend.\n\nSecond para here"), (1, 1, "a", "An answer"), (1, 2, "u", "Bob wrote:\n> Hello there  friend.\nI reply to first"),
        (1, 3, "a", "> > Hello there friend.\n> I reply to first\nnested"), (1, 4, "u", "> An answer\nback to answer"), (1, 5, "a", "continue"), (1, 5, "a", "continue"),
        (2, 0, "u", None), (2, 1, None, "> nothing known\nx"), (None, 0, "u", "alone"), (3, 0, "u", "> An answer\nother conversation"),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, g string").repartition(3)
    got = {(r["conv_id"], r["turn"]): r for r in link(frame).collect()}
    assert len(got) == 10
    assert [t for _, t in sorted((r["reply_order"], k[1]) for k, r in got.items() if k[0] == 1)] == [0, 1, 4, 5, 2, 3]
    assert {k[1]: r["reply_to"] for k, r in got.items() if k[0] == 1} == {0: None, 1: 1, 2: 1, 3: 3, 4: 2, 5: 5}
    assert {k[1]: r["depth"] for k, r in got.items() if k[0] == 1} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}
    assert got[1, 3]["text"] == "nested" and got[1, 3]["n_linked"] == 2
    assert got[2, 1]["n_linked"] == 0 and got[2, 1]["reply_to"] == 1 and got[3, 0]["n_linked"] == 0 and got[None, 0]["reply_order"] == 1


def test_quoted_often_and_held_often(spark):
    rows = [(1, i, "u", "the same words" if i % 2 == 0 else "> the same words\nyes") for i in range(300)]
    got = link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert all(r["reply_to"] == r["message"] - 1 and r["depth"] == r["turn"] for r in got if r["message"] > 1)
    assert link(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
