import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import line_quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(inside), failed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c\n", "d.", "#", "é", "\x1c", " ", "\n", "e\t"]), max_size=80))
def test_measures(words):
    text = " ".join(words)
    assert tuple(Q.measures(text).values())[:6] == brute(text)


def test_rules():
    fails = lambda line: Q.line_fails(line, line.split())
    assert fails("Home | About | Contact | Help") == "navigation"
    assert fails("All rights reserved.") == "boilerplate"
    assert fails("Read more about us on our newsletter page.") == "boilerplate"
    assert fails("SALE!! NOW!! ONLY!! TODAY!! HERE!!") == "punctuation"
    assert fails("word word word word word word word") == "punctuation"
    assert fails("alpha%%% beta*** gamma&&& delta### epsilon$$$") == "punctuation"
    assert fails("A quite ordinary sentence, with a comma and an end.") is None
    assert fails("an ordinary long line that ends without any mark at all") is None
    assert fails("Short but ended.") is None
    # a sentence that mentions a stock word, in the languages of the documents
    for line in ("The cookie recipe needs sugar, butter and two eggs, then bake it.",
                 "Copyright was first granted to printers, long before it was granted to authors.",
                 "Le cookie est un petit gâteau rond qui se mange à toute heure.",
                 "Das Copyright liegt seit dem letzten Jahr wieder bei der Familie des Malers.",
                 "El newsletter de la escuela llega cada lunes a todas las familias."):
        assert fails(line) is None


def test_lines_in_their_place():
    menu = ["Home", "About us", "Contact"]
    prose = "A quite ordinary sentence, with a comma and an end."
    assert Q.failures([*menu, "", prose]) == ["navigation"] * 3 + [None] * 2
    assert Q.failures(["Home", "", "About us", "", "Contact", prose])[::2] == ["navigation"] * 3
    assert Q.failures(["A heading", prose, "Une autre", prose, "Noch eine", prose]) == [None] * 6
    assert Q.failures(["- flour", "- two eggs", "* sugar", "1. Mix", "2) Bake", "a) Eat"]) == [None] * 6
    assert Q.failures(["", "  "]) == [None] * 2


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_clean_text_stays_line_by_line(lang):
    """Documents labelled good: their lines stay, in every language; of those labelled bad none is kept."""
    folder = "/root/testdata/sf0.1"
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    texts = [r for r in pq.read_table(f"{folder}/documents.parquet").to_pylist() if r["lang"] == lang and r["text"]]
    lines = [line for r in texts if quality.get(r["doc_id"]) == 1 for line in r["text"].split("\n") if line.split()]
    failed = [line for r in texts if quality.get(r["doc_id"]) == 1
              for line, rule in zip(r["text"].split("\n"), Q.failures(r["text"].split("\n")), strict=True) if rule]
    assert len(lines) > 1000 and len(failed) < 0.005 * len(lines)
    bad = [Q.measures(r["text"])["kept"] for r in texts if quality.get(r["doc_id"]) == 0]
    assert sum(bad) <= 0.02 * len(bad)


def test_losing_too_much():
    good = "This is one of the plain sentences that any document may well hold here."
    bad = "BUY!! THIS!! AT!! ONCE!! OR!! ELSE!! DEAR!! READER!! OF!! MINE!! {}!!"
    few, many = [bad.format(i) for i in range(1)], [bad.format(i) for i in range(9)]
    text = "\n".join([good, "Another sentence follows it, quite different from the first.", *few])
    assert Q.measures(text)["kept"] and "BUY" not in Q.cleaned(text)[0]
    assert not Q.measures("\n".join([good, *many]))["kept"]


def test_edges(spark, edge_docs, no_docs):
    got = Q.judge(edge_docs).collect()
    docs = edge_docs.collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [tuple(r)[:7] for r in sorted(got, key=key)] == [
        (d.doc_id, *brute(d.text or "")) for d in sorted(docs, key=key)]
    assert Q.judge(no_docs).count() == 0 and Q.keep_clean(no_docs).count() == 0
    kept = Q.keep_clean(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
