import hashlib
import random

import pytest

from clinisieve.llm import fixity

SCHEMA = "page_id bigint, url string, html string, digest string, file int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def plain_records(rows, per_file):
    files, out = {}, {}
    for i, url, html in rows:
        body = (html or "").encode()
        data = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url or ''}\r\n"
                f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
        files.setdefault(-1 if i is None else i // per_file, []).append((i is not None, i or 0, hashlib.sha256(data).hexdigest(), i, len(data)))
    for file, members in files.items():
        at, twins = 0, {}
        for _, _, digest, i, n in sorted(members, key=lambda m: m[:3]):
            twin = twins[i] = twins.get(i, -1) + 1
            out[(i, twin)] = (file, at, n, digest)
            at += n
    return out


def plain_audit(a, b):
    out = {}
    for key in a.keys() | b.keys():
        mine = a.get(key) or b[key]
        out[key] = (*mine, "missing" if key not in b else "extra" if key not in a else "intact" if a[key][3] == b[key][3] else "changed")
    return out


def corpus():
    rnd = random.Random(3)
    rows = [(i * rnd.choice([1, 1, 1, 3]) if i % 7 else i, f"http://x/{i}", "é<p>" * rnd.randint(0, 40)) for i in range(400)]
    return rows + [(None, "u", "h"), (None, None, None), (5, "a", None), (5, "a", None), (5, "b", ""), (-3, "n", "neg"), (90_000, "far", "z" * 5000)]


def damage(rows, kind):
    rows = list(rows)
    if kind == "bits":
        rows[50] = (rows[50][0], rows[50][1], "X" + (rows[50][2] or "")[1:])
        rows[399] = (rows[399][0], "http://y", rows[399][2])
    elif kind == "lost":
        del rows[120], rows[10]
    elif kind == "extra":
        rows += [(17, "new", "new"), (300_000, "new", "new")]
    elif kind == "everything":
        rows = [(i, u, (h or "") + "!") for i, u, h in rows]
    return rows


@pytest.mark.parametrize("kind", ["none", "bits", "lost", "extra", "everything"])
def test_damage_is_found(spark, kind):
    rows = corpus()
    other = damage(rows, kind)
    mine, theirs = (fixity.warc_records(pages(spark, r).repartition(3), per_file=16) for r in (rows, other))
    got = {(r.record_id, r.twin): (r.file, r.offset, r.n_bytes, r.digest, r.state) for r in fixity.audit(mine, theirs, span=256, fanout=4).collect()}
    want = plain_audit(plain_records(rows, 16), plain_records(other, 16))
    assert got == want
    assert {v[4] for v in want.values()} == {"none": {"intact"}, "bits": {"intact", "changed"}, "lost": {"intact", "missing"},
                                             "extra": {"intact", "extra"}, "everything": {"changed"}}[kind]


def test_only_mismatching_branches_are_walked(spark):
    rows = corpus()
    mine, theirs = (fixity.warc_records(pages(spark, r), per_file=16) for r in (rows, damage(rows, "bits")))
    one = fixity.build(mine, None, 256, 4)
    two = fixity.build(theirs, fixity.depth_of(one.records, 4), 256, 4)
    assert one.root() != two.root() and one.root() == fixity.build(mine.repartition(5), None, 256, 4).root()
    leaves = fixity.damaged_leaves(one, two, 4, fixity.depth_of(one.records, 4)).count()
    assert 1 <= leaves < one.levels[0].count() / 4


def test_empty_tables(spark):
    none = fixity.warc_records(pages(spark, []))
    some = fixity.warc_records(pages(spark, [(1, "u", "h")]))
    assert fixity.audit(none, none).count() == 0
    assert [r.state for r in fixity.audit(some, none).collect()] == ["missing"]
    assert [r.state for r in fixity.audit(none, some).collect()] == ["extra"]
