import random
import re
import textwrap

from turnstone.llm import licenses as L


def test_every_template_is_named_by_its_own_text():
    for name, text in L.TEMPLATES.items():
        got = L.identify(text)
        assert got[0] == name and got[2:] == (0, 0), (name, got)
        padded = f"some other words before it {text} and after"
        assert L.identify(padded)[0] == name, name


def test_wording_differences_decide():
    assert L.identify("This work is licensed under the GNU General Public License, version 4.")[0] is None
    assert L.identify("Licensed under CC BY-NC 3.0.")[0] is None
    assert L.identify("the town was licensed in 1900 to sell beer under a grand tree")[0] is None
    assert L.identify("This work is licensed under the terms of the GNU General Public License, version 3.")[0] == "GPL-3.0"
    assert L.differences("a b x c".split(), "a b c d".split()) == (1, 1, ["d"])


def test_ranking_equals_plain_compression():
    rng = random.Random(1)
    import zstandard

    block = "words " * 3 + L.TEMPLATES["MIT text"][:200] + "".join(rng.choice("abcdef ") for _ in range(80))
    size = len(zstandard.ZstdCompressor(level=6, write_content_size=False).compress(block.lower().encode()))
    for reduction, name in L.rank(block):
        d = zstandard.ZstdCompressionDict(L.TEMPLATES[name].lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        n = len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False).compress(block.lower().encode()))
        assert abs(reduction - (1 - n / size)) < 1e-12


def test_scan(spark):
    long = "word " * 30000
    rows = [(1, f"first line\n{L.TEMPLATES['Apache-2.0']}\nlast line", 0), (2, None, 0), (3, "", 0), (4, long + L.TEMPLATES["CC-BY-NC-4.0"] + " " + long, 0)]
    rows += [(5, "İ no licence here İ", 0), (5, "İ no licence here İ", 0), (None, L.TEMPLATES["MIT text"], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = L.scan_licenses(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(map(str, by)) == ["1", "4", "5", "None"]
    assert by[1][0].license == "Apache-2.0" and rows[0][1][by[1][0].start : by[1][0].end] == L.TEMPLATES["Apache-2.0"]
    assert by[4][0].license == "CC-BY-NC-4.0" and len(by[5]) == 2 and by[5][0].license is None and not by[5][0].confirmed
    assert by[None][0].license == "MIT text"
    assert L.scan_licenses(docs.limit(0)).count() == 0


def test_short_notices_in_long_lines():
    rng = random.Random(2)
    prose = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for name, text in L.TEMPLATES.items():
        line = f"{' '.join(rng.choices(prose, k=120))} the {text} under a {' '.join(rng.choices(prose, k=120))}"
        got = [x for a, b in L.blocks(line) for x in L.notices(line, a, b)]
        assert [(x[2], line[x[0] : x[1]]) for x in got] == [(name, text)], (name, got)
    two = [L.TEMPLATES["MIT"], L.TEMPLATES["CC-BY-NC-4.0"], L.TEMPLATES["MIT"]]
    line = f" {' '.join(rng.choices(prose, k=30))} ".join(["", *two, ""])
    got = [x for a, b in L.blocks(line) for x in L.notices(line, a, b)]
    assert [line[x[0] : x[1]] for x in got] == two


def test_parts_of_a_huge_block():
    text = "and so on " * 12000 + L.TEMPLATES["MIT"] + " or then " * 9000 + L.TEMPLATES["BSD text"]
    assert [x[2] for x in L.notices(text)] == ["MIT", "BSD text"]


def named(text):
    return [x[2] for a, b in L.blocks(text) for x in L.notices(text, a, b)]


def test_wrapped_templates_behind_comment_marks():
    for name, text in L.TEMPLATES.items():
        for width in range(60, 81):
            for mark in ("", "# ", "// ", " * ", "    ;; "):
                for before in ("", "The copy of 1999 by one or more hands and as it was then left to us. "):
                    lines = [mark + x for x in textwrap.wrap(before + text, width)]
                    for end in ("\n", "\r\n"):
                        assert named(end.join(["x = 1", "", *lines, "", "y = 2"])) == [name], (name, width, mark)


def test_wrapped_notices():
    assert named("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.") == ["MPL-2.0"]
    assert named("This work is licensed under the GNU Lesser General\nPublic License, version 3.") == ["LGPL-3.0"]
    assert named("Dedicated to the public\n# domain under CC0 1.0.") == ["CC0-1.0"]
    apache = L.TEMPLATES["Apache-2.0 notice"]
    assert named(re.sub(" (?=http|Unless)", "\n\n  ", apache)) == ["Apache-2.0 notice"]
    assert named(f"{L.TEMPLATES['MIT']}\n{L.TEMPLATES['BSD']}\n\nno\n\n{L.TEMPLATES['MIT']}") == ["MIT", "BSD", "MIT"]


def test_full_texts_and_identifiers():
    for name in ("MIT full", "BSD-2-Clause full", "ISC full"):
        text = L.TEMPLATES[name]
        paragraphs = re.sub(r" (?=THE SOFTWARE|THIS SOFTWARE IS|The above|[12]\. )", "\n\n", text)
        for t in (text, paragraphs, "\n".join(f" * {x}".rstrip() for p in paragraphs.split("\n\n") for x in [*textwrap.wrap(p, 72), ""])):
            whole = f"prose of no import goes here\n\nCopyright (c) 2021 Somebody\n\n{t}\n\nand other prose after it"
            assert named(whole) == [name], (name, named(whole))
    assert named("#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-or-later\n\n// SPDX-License-Identifier: MIT\n") == ["GPL-2.0-or-later SPDX", "MIT SPDX"]
    assert named("SPDX-License-Identifier: LicenseRef-own") == []


def test_every_block_equals_a_plain_search():
    """In random texts with notices: the words of each notice found are its template's, and every planted one is found."""
    rng = random.Random(9)
    names = [n for n, t in L.TEMPLATES.items() if len(t) < 200]
    for _ in range(60):
        planted = rng.choices(names, k=rng.randint(0, 4))
        parts = []
        for n in planted:
            parts += [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "license", "copyright"]) for _ in range(rng.randint(3, 400))) + ".", L.TEMPLATES[n]]
        text = rng.choice([" ", "\n", "\n\n"]).join([*parts, "the end"])
        assert named(text) == planted
        for a, b in L.blocks(text):
            for x, y, name, reduction, missing, added in L.notices(text, a, b):
                assert L.words(text[x:y]) == L.words(L.TEMPLATES[name]) and (missing, added) == (0, 0) and reduction > 0
    assert L.blocks("no trigger in here at all") == [] and L.blocks("") == []


def test_usual_variants():
    for text, name in (
        ("Licensed under the MIT license", "MIT name"),
        ("This project is licensed under the MIT License - see LICENSE.md", "MIT project"),
        ("Licensed under the Apache License 2.0", "Apache-2.0 name"),
        ("licensed under Creative Commons Attribution 4.0", "CC-BY-4.0 name"),
        ("Licensed under the GNU GPL v3.", "GPL-3.0 name"),
        ("BSD 3-Clause License", "BSD-3-Clause name"),
        ("the code is licensed under GPLv3 and so on", "GPL-3.0 short"),
    ):
        assert named(text) == [name], (text, named(text))
    assert named("licensed under Creative Commons Attribution 3.0") == [] and L.blocks("as GPLv3 says") != []


def plain_notices(text):
    """Ranking and confirmation by the book: every template on every window, nothing passed over, no least share."""
    import zstandard

    def size(data, dictionary=None):
        d = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        return len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False).compress(data.encode()) if d else zstandard.ZstdCompressor(level=6, write_content_size=False).compress(data.encode()))

    have, ranked = L.words(text), []
    longest = max((len(L.words(t)) for t in L.TEMPLATES.values() if set(L.words(t)) & set(have)), default=1)
    for name, template in L.TEMPLATES.items():
        w = L.words(template)
        n = next((c for c in L.CLASSES if len(w) <= c), max(longest, len(w)))
        own = " ".join(w)
        for k in range(0, len(have), n):
            data = " ".join(have[k : k + 3 * n])
            saved = size(data) - size(data, own)
            ranked.append((-saved, -saved / max(1, size(own) - size(own, own)), name, k, have[k : k + 3 * n], w))
    taken, out = [False] * len(have), []
    for _, _, name, k, window, w in sorted(ranked, key=lambda x: x[:4]):
        for x, y, lost, added in L.placements(window, w):
            forgiven = len(lost) <= L.MOST_MISSING * len(w) and not any(v in L._TELLING or re.search(r"\d", v) for v in lost) and not L._TELLING & set(added) - set(w)
            if forgiven and not any(taken[k + x : k + y]):
                taken[k + x : k + y] = [True] * (y - x)
                out.append((k + x, name, len(lost), len(added)))
    return [x[1:] for x in sorted(out)]


def test_ranking_and_confirmation_equal_a_plain_version():
    rng = random.Random(13)
    short = [n for n, t in L.TEMPLATES.items() if len(L.words(t)) < 40]
    filler = ["lorem", "license", "the", "under", "by", "version", "software", "mit", "and", "public", "gnu"]
    for _ in range(25):
        parts = []
        for n in rng.choices(short, k=rng.randint(1, 3)):
            w = L.TEMPLATES[n].split()
            if rng.random() < 0.5:
                w.insert(rng.randrange(len(w)), rng.choice(filler))
            if rng.random() < 0.3:
                w.pop(rng.randrange(len(w)))
            parts += [*rng.choices(filler, k=rng.randint(2, 40)), *w]
        text = " ".join(parts)
        assert [x[2:3] + x[4:] for x in L.notices(text)] == plain_notices(text), text
