"""Splitting against a walk from cut to cut."""

import random

import numpy as np
import pytest

from pandect.llm import splitting as S
from tests.conftest import rows

SCHEMA = "section_id string, law_name string, hierarchy_path string, position bigint, text string, updated_at timestamp_ntz, synced_at timestamp_ntz, size string, segment int, total int, cuts string"


def walk(text, limit, overlap):
    """Pieces by taking the farthest legal cut again and again."""
    cuts = S.legal_cuts(text, S.gap_of(limit, overlap)).tolist()
    out, at = [], 0
    while at < len(text):
        reach = at + (limit if at == 0 else limit - overlap)
        best = [c >> 1 for c in cuts if c & 1 and at + (limit - overlap) // 3 <= c >> 1 <= reach and c >> 1 > at]
        nxt = max(best) if best else max(c >> 1 for c in cuts if at < c >> 1 <= reach)
        out.append((max(at - overlap, 0), nxt))
        at = nxt
    return out


def prose(rng, n):
    words = ["the", "kiln", "must—", "be", "kept;", "clean.", "reg. 3", "x" * rng.choice([3, 40, 700]), "“tide”", "ŵyl", "a" * 9]
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def frame(spark, data):
    import datetime as dt

    t = dt.datetime(2022, 1, 1)
    return spark.createDataFrame([(*d, t, t, "clash", 1, 2, "x") for d in data], SCHEMA)


def test_pieces_equal_the_walk(spark):
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (400, 900, 30, 6000)] + ["y" * 5000, "z " * 9000, "a" * 1200, "b" * 1201, "", None, "   \n\t "]
    df = frame(spark, [(f"s{i}", "UK_uksi_2000_1", None, i, t) for i, t in enumerate(texts)])
    got: dict[str, list] = {}
    for r in S.numbered_pieces(df).orderBy("item_key", "piece_no").collect():
        got.setdefault(r["item_key"], []).append(r)
    for i, t in enumerate(texts):
        t = " ".join((t or "").split())
        if len(t) <= S.LIMIT:
            assert f"s{i}" not in got
            continue
        pieces = got[f"s{i}"]
        assert [(p["piece_start"], p["piece_end"]) for p in pieces] == walk(t, S.LIMIT, S.OVERLAP)
        assert [p["piece"] for p in pieces] == [t[p["piece_start"] : p["piece_end"]] for p in pieces]
        assert all(len(p["piece"]) <= S.LIMIT for p in pieces)
        assert all(b["piece_start"] == a["piece_end"] - S.OVERLAP for a, b in zip(pieces, pieces[1:], strict=False))
        assert pieces[-1]["piece_end"] == len(t)


def test_provisions(spark):
    rng = random.Random(8)
    sizes = [700] * 40 + [0, 5, 3000]
    data = [(f"u{i:03d}", "uk-uksi-2000-1", f"/part.1//provision.2/sub.{i}/", (i * 7) % 43 + 1000, " ".join(prose(rng, 1) for _ in range(3))[:s]) for i, s in enumerate(sizes)]
    data += [("v1", "UK_uksi_2000_1", "part.1/provision.3", None, "k" * 600), ("v2", "UK_UKSI_2000_1", "part.1/provision.3/sub.1", 4, "l" * 599), ("w", "UK_uksi_2000_1", "part.1", 5, "m" * 1100), ("n", None, None, None, "o" * 1201)]
    df = frame(spark, data)
    found = rows(S.found(df))
    assert ("provision", "UK_uksi_2000_1", "part.1/provision.2") in found
    assert ("provision", "UK_uksi_2000_1", "part.1/provision.3") not in found  # 600 + 1 + 599 is the limit
    assert ("unit", "", "n") in found and ("unit", "UK_uksi_2000_1", "w") not in found
    order = sorted((d for d in data if d[0].startswith("u")), key=lambda d: (d[3], d[0]))
    whole = "\n".join(" ".join(d[4].split()) for d in order)
    p = [r for r in S.numbered_pieces(df).orderBy("piece_no").collect() if r["item_key"] == "part.1/provision.2"]
    assert p[0]["piece"] + "".join(r["piece"][S.OVERLAP :] for r in p[1:]) == whole
    assert all(len(r["piece"]) <= S.LIMIT for r in p)


def test_empty(spark):
    assert S.found(frame(spark, [("a", "b", "c", 1, "d")]).limit(0)).count() == 0
    assert S.numbered_pieces(frame(spark, [("a", "b", "c", 1, "d")])).count() == 0


@pytest.mark.parametrize(("limit", "overlap"), [(1200, 100), (50, 10), (7, 2)])
def test_successors_make_progress(limit, overlap):
    rng = random.Random(limit)
    for _ in range(50):
        text = " ".join(prose(rng, rng.randint(1, 60)).split())
        cuts = np.concatenate([[0], S.legal_cuts(text, S.gap_of(limit, overlap))])
        nxt = S.successors(cuts, limit, overlap)
        assert all(n > i for i, n in enumerate(nxt[:-1])) and nxt[-1] == len(cuts) - 1
        path = S.path_from(0, nxt)
        at = [int(cuts[i] >> 1) for i in path]
        assert [(max(a - overlap, 0), b) for a, b in zip(at[:-1], at[1:], strict=True)] == walk(text, limit, overlap)


