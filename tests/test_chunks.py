"""Chunks of every document of the smallest tables against a plain walk over their lines, and the run log."""

import re

from pyspark.sql import functions as F

from dossierlake.operators import chunks as c
from dossierlake.operators import vectors as v
from dossierlake.plans.documents import headed, pieces, runs
from dossierlake.plans.fixtures import Tables

SMALL = "/root/testdata/sf0.001"
MARKED, NUMBERED, CAPITALS = re.compile(r"^#{1,6}\s+(.+)$"), re.compile(r"^\d+(?:\.\d+)*\.?\s+([A-Z].+)$"), re.compile(r"^[A-Z\s0-9.,&-]{5,100}$")


def plain_sections(text):
    """(title, lines of the body) by one walk: what is before the first heading has no title."""
    lines, out, skip = text.split("\n"), [(None, [])], False
    for i, raw in enumerate(lines):
        if skip:
            skip = False
            continue
        line, below = raw.strip(" "), lines[i + 1].strip(" ") if i + 1 < len(lines) else ""
        if line and re.match(r"^[-_]{4,}$", below):
            out.append((line, [line]))
            skip = True
            continue
        for heading in (MARKED, NUMBERED, CAPITALS):
            if m := heading.match(line):
                out.append((m[1] if m.re.groups else line, [raw]))
                break
        else:
            out[-1][1].append(raw)
    return [(t, "\n".join(b)) for t, b in out if b]


def plain_merged(sections):
    out = []
    for title, body in sections:
        if out and len(out[-1][1]) / 4 < 200:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + body)
        else:
            out.append((title, body))
    return out


def test_sections_and_chunks_of_every_document(spark):
    docs = headed(Tables(spark, SMALL))
    rows = docs.select("doc_id", "text", F.transform(c.merge_small_sections(c.split_sections(F.col("text"))), lambda s: F.struct(s["title"], s["body"])).alias("s")).collect()
    chunks = {}
    for r in c.chunk_links(c.chunk_text(docs)).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r.doc_id, []).append(r)
    long = 0
    for r in rows:
        want = plain_merged(plain_sections(r.text))
        assert [tuple(s) for s in r.s] == want
        mine = chunks[r.doc_id]
        assert [x.chunk_index for x in mine] == list(range(len(mine))) and all(x.total_chunks == len(mine) for x in mine)
        assert [x.chunk_id for x in mine] == [f"{r.doc_id}-{i:05d}" for i in range(len(mine))]
        assert [x.prev_chunk_id for x in mine] == [None, *[x.chunk_id for x in mine[:-1]]] and [x.next_chunk_id for x in mine] == [*[x.chunk_id for x in mine[1:]], None]
        assert all(x.token_count == int(len(x.text) / 4) and x.char_count == len(x.text) for x in mine)
        at = 0
        for title, body in want:
            if not body.strip():
                continue
            if int(len(body) / 4) <= 1000:
                assert (mine[at].section_title, mine[at].text) == (title, body)
                at += 1
                continue
            # pieces of a long section: in order, none too long, overlapping by 600 characters at most, and nothing lost
            end, long = 0, long + 1
            while end < len(body.rstrip()):
                piece = mine[at].text
                start = max(end - 600, 0)
                found = body.find(piece, start)
                assert mine[at].section_title == title and len(piece) <= 3200 and start <= found <= end + 1
                end, at = found + len(piece), at + 1
        assert at == len(mine)
    assert long > 5 and len(rows) == 200


def test_vectors_of_chunks(spark):
    docs = headed(Tables(spark, SMALL)).where("doc_id < 40")
    chunks = c.chunk_text(docs)
    first = {r.doc_id: (r.chunk_id, r.text) for r in chunks.where("chunk_index = 0").collect()}
    embedded = chunks.select("chunk_id", v.embed_texts(F.col("text")).alias("v"))
    got = v.doc_vector(chunks, embedded).collect()
    assert {r.doc_id: r.chunk_id for r in got} == {d: i for d, (i, _) in first.items()}
    for r in got:
        assert abs(sum(x * x for x in r.v) - 1) < 1e-9 or not any(r.v)
    meta = {r.chunk_id: r for r in v.vector_metadata(chunks).collect()}
    assert all(meta[r.chunk_id].section_title == (r.section_title or "") and meta[r.chunk_id].token_count == r.token_count for r in chunks.collect())


def test_failed_runs_leave_the_error_alone(spark):
    t = Tables(spark, SMALL)
    log = {r.doc_id: r for r in c.processing_log(runs(t), pieces(t)).collect()}
    assert len(log) == 200
    for i, r in log.items():
        rest = [x for k, x in r.asDict().items() if k not in ("doc_id", "pipeline_version", "error_detail")]
        assert (all(x is None for x in rest) and r.error_detail) if i % 9 == 0 else (all(x is not None for x in rest) and r.error_detail is None)
