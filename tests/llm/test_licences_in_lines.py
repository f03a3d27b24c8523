"""Licences that share their lines with other words, against every run of words."""

import collections
import random
import re

from loamframe.llm import license_scan, queries
from loamframe.llm.licence_templates import ALL_TEMPLATES, MIT


def windows(text, templates, least=0.8):
    """(licence, form, dice) of the best run of words, tried one by one."""
    pairs = lambda w: list(zip(w, w[1:]))
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
    own, out = pairs(words(text)), []
    for licence, form, body in templates:
        template, best = collections.Counter(pairs(words(body))), 0
        size = sum(template.values())
        for i in range(len(own)):
            seen, common = collections.Counter(), 0
            for j in range(i, min(len(own), i + 2 * size)):
                seen[own[j]] += 1
                common += seen[own[j]] <= template[own[j]]
                best = max(best, 2 * common / (j - i + 1 + size))
        if best >= least:
            out.append((licence, form, best))
    return out


def test_licences_inside_long_lines(spark, tmp_path):
    rnd = random.Random(3)
    prose = lambda n: " ".join(f"w{rnd.randrange(1000)}" for _ in range(n))
    short = [t for t in ALL_TEMPLATES if len(t[2]) < 4000]
    texts = [f"{prose(9)} {' '.join(body.split())} {prose(60)}" for _, _, body in ALL_TEMPLATES]
    texts += [f"{prose(5)}\n{prose(9)} {MIT.replace('Software', 'Program')} {prose(300)}", f"{prose(4)} Released under the\nMIT License. {prose(4)}", prose(50), "", MIT[:600]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_license_scan(spark, str(tmp_path)).collect()
    small = {i for i, t in enumerate(texts) if len(t) < 6000}
    assert sorted((r["doc_id"], r["licence"], r["form"], r["dice"]) for r in got if r["doc_id"] in small) == sorted(
        (i, *w) for i in small for w in windows(texts[i], short))
    found = {(r["doc_id"], r["licence"], r["form"]): r for r in sorted(got, key=lambda r: r["dice"])}
    assert all(found[i, licence, form]["dice"] == 1 for i, (licence, form, _) in enumerate(ALL_TEMPLATES))
    at = len(ALL_TEMPLATES)
    assert (found[at, "MIT", "text"]["first_line"], found[at, "MIT", "text"]["last_line"]) == (1, 3)
    assert (found[at + 1, "MIT", "line"]["first_line"], found[at + 1, "MIT", "line"]["last_line"]) == (0, 1)
    before = {r["doc_id"] for r in license_scan.scan_licences(df).collect()}
    assert 1 not in before and at + 1 not in before
