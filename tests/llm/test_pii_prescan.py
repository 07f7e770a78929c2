"""The scan that selects texts for rewriting selects every text that rewriting changes."""

import pyarrow as pa
import random
import re

from strideflow.llm import pii

HIDDEN = {
    "write to jane at example.com": "jane at example.com",
    "jane arroba sitio.es": "jane arroba sitio.es",
    "jane chez  site-1.fr now": "jane chez  site-1.fr",
    "bob [ at ] site.org": "bob [ at ] site.org",
    "bob {　at\x0b} site.org": "bob {　at\x0b} site.org",
    "ian [at] site.fi now": "ian [at] site.fi",
}


def test_hidden_addresses_are_found_in_a_table(docs_of):
    rows = dict(enumerate(HIDDEN))
    out = {r.doc_id: r for r in pii.find_pii(docs_of(list(rows.items()))).collect()}
    for i, text in rows.items():
        start = text.index(HIDDEN[text])
        assert (out[i].spans, out[i].n_disguised) == (f"email:{start}:{start + len(HIDDEN[text])}", 1), text
    assert {r.text for r in pii.redact(docs_of([(1, "write to jane at example.com")])).collect()} == {"write to [EMAIL]"}


def test_every_changed_text_is_selected(docs_of):
    spaces = "".join(filter(str.isspace, map(chr, range(0x3001))))
    assert all(re.fullmatch(r"\s", c) for c in spaces)
    rng = random.Random(6)
    words = ["at", "AT", "arroba", "chez", "dot", "punkt", "punto", "poİnt", "@", ".", "a", "b9", "-", "İ", "K", "ſ",
             "FİVE", "one", "ſix", "plus", "null", "ı", "(", ")", "[", "]", "α", "У", "", "host.com"]
    rows = []
    for i in range(30_000):
        gaps = [" ", " ", " ", "", "-", "  ", rng.choice(spaces)]
        rows.append((i, "".join(w for _ in range(rng.randrange(3, 10)) for w in (rng.choice(words), rng.choice(gaps)))))
    rows += [(len(rows) + k, f"a [{c}at{c}] b") for k, c in enumerate(spaces)]
    selected = set(pii._hits(pii.pa.array([t for _, t in rows]))[1])
    changed = {i for i, t in rows if pii.rewrite(t)[0] != t}
    assert len(changed) > 1000 and changed <= selected, [rows[i][1] for i in sorted(changed - selected)][:10]
    assert pii.rewrite("ill-fitting with У")[0] == "ill-fitting with У"


def test_further_disguises_are_mapped_back():
    cases = {
        "write to jane@example。com now": ("email", "jane@example。com"),
        "write to jane&#64;example&period;com now": ("email", "jane&#64;example&period;com"),
        "card 4111‑1111 1111–1111 ok": ("card", "4111‑1111 1111–1111"),
        "host one two seven dot zero dot zero dot one up": ("ip", "one two seven dot zero dot zero dot one"),
    }
    for text, (kind, part) in cases.items():
        hits, hidden = pii._hits(pa.array([text]))
        assert hits == [0] and hidden == {0}, text
        base, every = pii.find_text(text, True)
        assert base == [] and [(pii.KINDS[k], text[s:e]) for k, s, e in every] == [(kind, part)], text
    for text in ("1990–1995 and 12 000 Euro", "a。b", "R&amp;D 50", "one dot two"):
        assert pii.find_text(text, True)[1] == []
