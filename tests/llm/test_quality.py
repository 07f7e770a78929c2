import random
import re

from strideflow.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside))


def test_base_counts_equal_brute_force(docs_of, odd):
    rng = random.Random(1)
    pieces = ["a", "b", "the", " ", "  ", "\n", "\t", "\x0b", "#", "é", "漢", "😀", " ", " ", "x|y"]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice([" ", "", "\n"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "a b c a b c a"), (1004, "a a a a")]
    out = {r.doc_id: r for r in Q.judge(docs_of(rows)).collect()}
    for i, text in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text), repr(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert Q.judge(odd).count() == odd.count()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def test_the_method_drops_what_is_unlike_its_language(docs_of):
    rng = random.Random(2)
    en = "the of and to in is that for it house tree river stone cloud winter summer letter number garden".split()
    de = "der die und das den mit ist nicht haus baum fluss stein wolke winter sommer brief zahl garten".split()
    rows = [(i, prose(rng, en, 200), "en") for i in range(60)] + [(100 + i, prose(rng, de, 200), "de") for i in range(60)]
    rows += [(200, " ".join(f"{w}$$$###" for w in rng.choices(en, k=200)), "en")]
    rows += [(201, " | ".join("".join(rng.choices("bcdfgh", k=9)) for _ in range(200)), "en")]
    rows += [(202, prose(rng, de, 200), None), (203, prose(rng, en, 20), "en")]
    out = {r.doc_id: r for r in Q.judge(docs_of(rows)).collect()}
    assert all(out[i].kept for i in range(60)) and all(out[100 + i].kept for i in range(60))
    assert not out[200].kept and not out[201].kept and not out[203].kept and out[202].kept
    assert 0 <= out[0].char_distance < 0.2 < out[200].char_distance <= 1


def test_empty_table_and_native_plan(nothing, docs_of):
    assert Q.judge(nothing).count() == 0
    plan = Q.features(docs_of([(1, "a b c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
