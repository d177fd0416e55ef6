import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import html_extraction, language_id, packing, quality_rules, sentencepiece_codec
from gleanery.llm.queries import PIECE_MODEL, WORD_MODEL, vocabulary

MARKED = ["▁ ▁", "▁ ▁a", "a▁ ▁", "▁▁ a", "a ▁", "a ▁b▁ c", " ▁ ", "x▁y z"]
TEXTS = [*MARKED, "", "a", " a", "a ", "  ", "a  b", " ", "▁", "▁a", "a\tb\n c", "\n", "é ̈x", "\x00a b", "日本 語 😀", "a~b ~ ~~", "<|endoftext|> x", "don't it's 'tis", "１２ x", "\xa0a\u3000b", "ÉCOLE.!! İ x", "\r\n a", "word " * 500, "Ünï,., çà!?"]


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(vocabulary(PIECE_MODEL))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_pieces_equal_the_library(codec, text):
    check_pieces(codec, text)


@settings(max_examples=300, deadline=None)
@given(st.text("▁ ab\n", max_size=12))
def test_pieces_around_spaces_equal_the_library(codec, text):
    check_pieces(codec, text)


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_of_edge_cases(codec, text):
    check_pieces(codec, text)


def check_pieces(codec, text):
    want = codec.engine.encode(text)
    ids = codec.encode(text)
    assert ids.tolist() == want
    assert codec.decode(ids) == codec.engine.decode(want)
    begins, ends = codec.spans(text, ids)
    data = text.encode()
    assert all(a <= b for a, b in zip(begins, ends)) and all(a == b for a, b in zip(begins[1:], ends[:-1]))
    assert b"".join(data[a:b] for a, b in zip(begins, ends)) == data


def test_compiled_maps_take_the_longest_prefix():
    """A hand-made double array with the keys 'a' -> 'x' and 'ab' -> 'yz'."""
    units = [0] * 512

    def leaf(value):
        return 0x80000000 | value

    # Root at 0 with offset 256; 'a' at 256 ^ 97; its offset leads to a block at 0 ^ ...
    root_offset = 256
    units[0] = root_offset << 10
    a = root_offset ^ 97
    units[a] = 97 | 1 << 8 | (a ^ 128) << 10
    units[128] = leaf(0)
    ab = 128 ^ 98
    units[ab] = 98 | 1 << 8 | (ab ^ 64) << 10
    units[64] = leaf(2)
    blob = np.array([len(units) * 4, *units], "<u4").tobytes() + b"x\0yz\0"
    spec = b"\x12" + varint(len(blob)) + blob + b"\x18\x00\x20\x00\x28\x00"
    normal = sentencepiece_codec.Normalizer(spec)
    out, align = normal.normalize("cabaé")
    assert out == "cyzxé".encode()
    assert align.tolist() == [0, 1, 1, 3, 4, 4, 6]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def tokenizer():
    return packing.WordTokenizer(vocabulary(WORD_MODEL), cache_words=50)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_words_equal_the_library(tokenizer, text):
    assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.engine.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_words_of_edge_cases(tokenizer, text):
    assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.engine.encode(text, add_special_tokens=False).ids


def test_plans_use_every_item_once_with_little_padding():
    rng = random.Random(3)
    for count in (0, 1, 7, 300):
        histogram = Counter(min(64, 1 + int(rng.expovariate(0.08))) for _ in range(count))
        plan = packing.plan_windows(dict(histogram), 64)
        used = Counter()
        for times, pattern in plan:
            assert times > 0 and sum(length * n for length, n in pattern) <= 64
            for length, n in pattern:
                used[length] += times * n
        assert used == histogram
        padding = sum(times * (0 if (total := sum(x * n for x, n in pattern)) & (total - 1) == 0 else 64 - total) for times, pattern in plan)
        assert padding <= 64 * 2


def test_a_window_is_filled_exactly_if_it_can_be():
    assert sum(length * n for length, n in packing.fill({60: 1, 7: 3, 5: 2, 4: 1}, 60, 64)) == 64
    assert sum(length * n for length, n in packing.fill({40: 1, 11: 1, 9: 1}, 40, 64)) == 60
    assert packing.fill({33: 1}, 33, 64) == [(33, 1)]


def brute_repeats(words, window=8):
    places = defaultdict(list)
    for k in range(len(words) - window + 1):
        places[tuple(words[k : k + window])].append(k)
    return len({k + j for found in places.values() if len(found) > 1 for k in found for j in range(window)})


def test_repeated_words_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_quality_rules():
    good = "\n".join(f"Sentence {k} has {k + 7} words or {k * 3} more, and {k}{k} ends." for k in range(5))
    found = quality_rules.judge(good)
    assert found[6] and found[-1] == good and found[0] == 55
    for junk in ("home | about | news | more | contact | help", "BUY!! NOW!! ALL!! THINGS!! CHEAP!!", "spam spam spam spam spam spam", "a### b%%% c$$$ d*** e&&&"):
        assert quality_rules.line_fails(junk, quality_rules.Rules())
        bad = "\n".join([junk + " " + str(k) for k in range(40)] + ["One good line stays here, as it should."])
        assert not quality_rules.judge(bad)[6]
        one = quality_rules.judge(good + "\n" + junk)
        assert one[6] and one[-1] == good
    assert quality_rules.judge(None)[:7] == (0, 0, 0, 0, 0, True, False)
    assert quality_rules.judge("a\n\na \na\x0bb")[:4] == (4, 4, 0, 0)
    assert quality_rules.judge("x\xa0y z\u2028w")[0] == len(re.findall(r"[^\x20\x09-\x0D]+", "x\xa0y z\u2028w"))


def test_sentences_of_any_writing_end():
    for line in ("یہ ایک جملہ ہے۔", "هل هذه جملة؟", "यह एक वाक्य है।", "これは文です。", "Αυτή είναι πρόταση.", "Սա նախադասություն է։"):
        text = "\n".join(f"{k} {line}" for k in range(12))
        assert quality_rules.judge(text)[6], line
    assert quality_rules.line_fails("We use cookies to give you more.", quality_rules.Rules()) == "boilerplate"


def brute_counts(text):
    """Base counts by the contract's words, written apart."""
    space = set(" \t\n\v\f\r")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(x not in space for x in line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), sum(text.count(x) for x in "#*$%&|<>"), dup, brute_repeats(found)


@settings(max_examples=200, deadline=None)
@given(st.text("ab #\n\t|é\xa0", max_size=80))
def test_base_counts_by_brute_force(text):
    want = brute_counts(text)
    found = quality_rules.judge(text)
    assert found[:5] == want and found[5] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice"><p>We use cookies here for many reasons that nobody wants to read.</p></div>
<main><article><h1>A &amp; B</h1><p><b>First  para&#8212;graph.<br><p>Second
 one.</p><aside>Related reading for you, dear reader of ours.</aside><div class="ad">Buy this very good thing right now.</div><form><label>Name</label></form>
<section id="comments"><p>What a nice article this was, I liked it a lot.</p></section></article></main><footer>&copy; us</footer><script>x="<p>no</p>"</script></body></html>"""


def words(n, start=0):
    return " ".join(f"word{start + k}" for k in range(n))


LONG = [words(60), words(45, 100), words(80, 200)]
BODY = "<h1>A head</h1>" + "".join(f"<p>{text}</p>" for text in LONG)
WANT = "\n".join(["A head", *LONG])
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav>"
#: Page shapes, and what their main text adds to, or changes in, WANT.
SHAPES = {
    "plain": (f"<body>{NAV}<article>{BODY}</article><footer>(c) us</footer></body>", WANT),
    "layout class": (f"<div class='wrap has-sidebar'><article>{BODY}</article></div><div class=sidebar>{words(9, 900)}</div>", WANT),
    "page wrapper": (f"<div class='page-with-comments'><main>{BODY}</main></div>", WANT),
    "main column": (f"<div class='main sidebar-right'>{BODY}</div><div class=sidebar><a>x</a></div>", WANT),
    "named wrapper around the article": (f"<div class=newsletter><article>{BODY}</article></div>", WANT),
    "link paragraph": (f"<article>{BODY}<p><a href=x>read {words(4, 500)}</a></p><p>{words(30, 600)}</p></article>", f"{WANT}\nread {words(4, 500)}\n{words(30, 600)}"),
    "link list": (f"<article>{BODY}<ul><li><a>{words(5, 500)}</a><li><a>{words(4, 600)}</a><li><a>{words(6, 700)}</a></ul></article>", WANT),
    "unlisted comments": (f"<article>{BODY}</article><div class=user-opinions><p>{words(30, 800)}</p><p>{words(40, 900)}</p></div>", WANT),
    "comments by heading": (f"<article>{BODY}<div><h3>3 comments</h3><p>{words(30, 800)}</p><p>{words(50, 900)}</p></div></article>", WANT),
    "comments inside": (f"<article>{BODY}<section id=comments><p>{words(44, 800)}</p></section></article>", WANT),
    "advert paragraph": (f"<article><p class=mkt>{words(12, 800)}</p>{BODY}</article>", WANT),
    "advert in between": (f"<article>{BODY}<div class='ad-slot'>{words(15, 800)}</div><p>{words(5, 900)}</p></article>", f"{WANT}\n{words(5, 900)}"),
    "short paragraphs": (f"<article>{BODY}<p>One.</p><p>Two words.</p></article>", f"{WANT}\nOne.\nTwo words."),
    "short article": ("<article><h1>Head</h1><p>Only this.</p></article><footer>us</footer>", "Head\nOnly this."),
    "no article": (f"<div><a>Home</a></div><div><a>News</a></div><div>{BODY}</div><div><a>More</a> <a>Less</a></div>", WANT),
    "tables": (f"<table><tr><td><a>x</a><td><a>y</a></table><table><tr><td>{LONG[0]}<tr><td>{LONG[2]}</table>", f"{LONG[0]}\n{LONG[2]}"),
    "forms and buttons": (f"<article>{BODY}<form><label>Your name</label><input><button>Send it</button></form></article>", WANT),
    "aside": (f"<article>{BODY}<aside>{words(30, 800)}</aside></article>", WANT),
    "cookie notice": (f"<div class=cookie-notice><p>{words(40, 800)}</p></div><article>{BODY}</article>", WANT),
    "hidden": (f"<article>{BODY}<div hidden>{words(40, 800)}</div><div style='display: none'>{words(40, 900)}</div></article>", WANT),
    "references": (f"<article>{BODY}<p>&lt;b&gt; &amp; &#8212; &eacute;</p></article>", f"{WANT}\n<b> & — é"),
    "nested blocks": (f"<article><div><section>{BODY}</section></div><blockquote><p>{words(9, 700)}</p></blockquote></article>", f"{WANT}\n{words(9, 700)}"),
    "role": (f"<div role=navigation><a>Home</a></div><div role=main>{BODY}</div><div role=contentinfo>{words(20, 700)}</div>", WANT),
    "related content": (f"<body>{NAV}<div class='related-content'>{BODY}</div><footer>(c) us</footer></body>", WANT),
    "history form": (f"<body>{NAV}<div class='history-form'>{BODY}</div></body>", WANT),
    "search results": (f"<body>{NAV}<div class='search-results'>{BODY}</div><div class=sidebar>{words(30, 900)}</div></body>", WANT),
    "post header": (f"<body>{NAV}<div class='post-header'><h1>A head</h1></div>{BODY.removeprefix('<h1>A head</h1>')}</body>", WANT),
    "post header in an article": (f"<article><div class='entry-header'><h1>A head</h1></div>{BODY.removeprefix('<h1>A head</h1>')}</article>", WANT),
    "nothing but a notice": (f"<body>{NAV}<div class='cookie-notice'><p>{words(40)}</p></div><div class='comment-list'><p>{words(50)}</p></div></body>", ""),
    "related beside the article": (f"<article>{BODY}</article><div class='related-content'><p>{words(40, 800)}</p></div>", WANT),
    "scripts": (f"<article><script>var a='<p>{words(9)}</p>'</script><style>p{{}}</style>{BODY}<!-- <p>x</p> --></article>", WANT),
}


@pytest.fixture(scope="module")
def tree():
    return html_extraction.grow(html_extraction.labelled_rows())


@pytest.mark.parametrize("shape", SHAPES)
def test_page_shapes(tree, shape):
    page, want = SHAPES[shape]
    assert html_extraction.main_text(page, tree)[0] == want


def test_html(tree):
    assert html_extraction.main_text(PAGE, tree)[0] == "A & B\nFirst para—graph.\nSecond one."
    for page in (None, "", "<", "<!--", "<p", "</p></div>", "<script>never closed", "<head><title>x"):
        html_extraction.main_text(page, tree)
    assert html_extraction.main_text("<p>" + "word " * 30 + "</p><p>" + "more " * 30 + "</p>", tree)[0].count("\n") == 1
    rows = html_extraction.labelled_rows()
    assert sum(html_extraction.is_main(tree, row[:-1]) == bool(row[-1]) for row in rows) / len(rows) >= 0.98


def test_neighbours_decide(tree):
    """Without the features of the blocks around, other blocks are taken for main text."""
    rows = html_extraction.labelled_rows()
    blind = [(0, 0, row[2], row[3], 0, 0, *row[6:]) for row in rows]
    wrong = sum(html_extraction.is_main(html_extraction.grow(blind), row[:-1]) != bool(row[-1]) for row in blind)
    assert wrong > sum(html_extraction.is_main(tree, row[:-1]) != bool(row[-1]) for row in rows)
    used = set()

    def collect(node):
        if isinstance(node, html_extraction.Split):
            used.add(html_extraction.FEATURES[node.feature])
            collect(node.low)
            collect(node.high)

    collect(tree)
    assert {"words_before", "density_before", "words_after", "density_after"} <= used


def test_language_models():
    rng = random.Random(5)
    syllables = {"xa": ["ka", "ro", "mi"], "yb": ["sch", "ung", "ein"], "zc": ["ção", "lho", "que"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    model = language_id.calibrate(language_id.learn({lang: [text(lang) for _ in range(30)] for lang in syllables}), {lang: [text(lang) for _ in range(8)] for lang in syllables})
    assert all(model.predict(text(lang))[0] == lang for lang in syllables for _ in range(20))
    assert model.predict(None) == model.predict("12 ?!") == ("und", 0.0, False)
    assert not model.predict("hello world completely different")[2]
    # Probabilities after a context, with that of a character never seen, sum to one.
    letters = sorted({int(x) for lang in syllables for _ in range(60) for x in language_id.characters(text(lang))})
    for context in ("ka", "ung", "q"):
        points = [np.array([32, 32, 32, 32, *map(ord, context), x], np.uint64) for x in letters]
        sums = sum(np.exp(model._log_likelihood(p, len(p) - 1)) for p in points)
        assert np.all(sums <= 1 + 1e-9) and np.all(sums > 0.9)
    assert language_id.learn({}).predict("abc")[0] == "und"


def test_kneser_ney_by_hand():
    """Interpolated Kneser-Ney of order 2 over one text, computed with plain counters."""
    model = language_id.learn({"xx": ["abab ba"]}, order=2)
    text = " abab ba "
    pairs, top = list(zip(text, text[1:])), Counter(zip(text, text[1:]))
    before = {c: len({a for a, b in pairs if b == c}) for c in set(text[1:])}
    counts = list(before.values())
    rate = lambda ns: (o / (o + 2 * t)) if (o := sum(n == 1 for n in ns)) and (t := sum(n == 2 for n in ns)) else 0.5
    low, high, base = rate(counts), rate(list(top.values())), 1 / (len(set(text)) + 1)
    unigram = {c: (before[c] - low) / sum(counts) + low * len(counts) / sum(counts) * base for c in before}
    total = 0.0
    for a, b in zip(" ba ", "ba "):
        row = {c: n for (x, c), n in top.items() if x == a}
        rest = unigram.get(b, low * len(counts) / sum(counts) * base)
        weight = high * len(row) / sum(row.values()) if row else 1.0
        total += np.log(max(row.get(b, 0) - high, 0) / sum(row.values()) + weight * rest if row else rest)
    assert abs(model.entropies("ba")[0] + total / 3) < 1e-9


def test_digest_form():
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(",".join(map(str, [])).encode()).hexdigest()


def test_remembered_words():
    from gleanery.llm.common import LONGEST_REMEMBERED, Remembered

    learned = []
    words = Remembered(lambda new: learned.extend(new) or [word.upper().encode() for word in new], 3)
    long = "x" * (LONGEST_REMEMBERED + 1)
    for k in range(200):
        asked = ["often", f"w{k}", "often", long]
        assert words(asked) == [word.upper().encode() for word in asked]
        assert len(words.recent) + len(words.older) <= 12
    assert learned.count("often") == 1 and learned.count(long) == 200
    assert words([]) == []
    many = [f"m{k}" for k in range(50)]
    assert words(many) == [word.upper().encode() for word in many]
    assert len(words.recent) + len(words.older) <= 12


def test_pages_of_many_open_elements_take_linear_time():
    import time

    from gleanery.llm import html_extraction

    for page in ("<div>" * 100_000, "<b>" * 50_000 + "<p>x" * 50_000, "<svg/><head>" * 50_000, "<a>x" * 100_000, "<h1>Comments<div>x" * 50_000):
        began = time.process_time()
        html_extraction.text_blocks(page)
        assert time.process_time() - began < 5  # by squares it would be minutes
