"""Parts of the operators without Spark, against plain forms."""

import random
import time

import numpy as np
import pytest

from scriptorium.llm import bpe, html_blocks, langid, lsh_forest, mixing, partenum, pst, secrets_crf, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


# --- Secrets


def full_viterbi(field, shapes, file):
    e = field.scores(shapes, file)
    best = np.where([True, True, False], 0.0, -1e9) + e[0]
    back = []
    for t in range(1, len(shapes)):
        total = best[:, None] + field.moves
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + e[t]
    tag, out = int(best.argmax()), {}
    for t in range(len(shapes) - 1, -1, -1):
        if tag:
            out[t] = tag
        tag = int(back[t - 1][tag]) if t else 0
    return out


def test_cut_chains_decode_like_whole_ones():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = len(secrets_crf.SHAPES)
        field = secrets_crf.Field(rng.normal(0, 2, (3, n, 3)), rng.normal(0, 1, (4, 5, 3)), rng.normal(0, 1, (secrets_crf.FILES, 3)), rng.normal(0, 2, (3, 3)))
        codes = rng.integers(0, n, size := rng.integers(1, 40)) + 32 * rng.integers(0, 5, size)
        assert field.tags(codes, 1) == full_viterbi(field, codes, 1)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    windows = []
    for n in (1, 2, 5, 9):
        codes = secrets_crf.padded(rng.integers(0, len(secrets_crf.SHAPES), n) + 32 * rng.integers(0, 4, n))
        windows.append((codes.tobytes(), bytes(rng.integers(0, 3, n).tolist()), int(rng.integers(0, secrets_crf.FILES)), int(rng.integers(1, 5))))
    likelihood = secrets_crf.Likelihood(windows, 4)
    v = rng.normal(0, 1, len(likelihood.start()))
    value, g = likelihood(v)
    for i in rng.choice(len(v), 60, replace=False):
        step = np.zeros_like(v)
        step[i] = 1e-5
        assert g[i] == pytest.approx((likelihood(v + step)[0] - likelihood(v - step)[0]) / 2e-5, abs=1e-4)
    # The likelihood itself, by the sum over all tag sequences of the window of two tokens.
    codes, tags, file, count = windows[1]
    two = secrets_crf.Likelihood([windows[1]], 4, ridge=0.0)
    field = secrets_crf.Field(*two.parts(v))
    e = field.scores(np.frombuffer(codes, np.uint16)[3:-1], file)
    every = np.array([[e[0, a] + field.moves[a, b] + e[1, b] for b in range(3)] for a in range(3)])
    assert two(v)[0] == pytest.approx(count * (every[tags[0], tags[1]] - np.log(np.exp(every).sum())))


def test_base_spans():
    kinds = lambda t: secrets_crf.joined(secrets_crf.base_spans(t))
    assert kinds('my PassWord = "abc123x" end') == "assign:3:22"
    assert kinds("token=abc") == "" and kinds("token=token:abcdefgh") == ""
    assert kinds("AKIA" + "A1" * 8) == "access:0:20" and kinds("AKIA" + "A" * 15) == ""
    assert kinds("x" + "0f" * 12 + "g") == "hex:1:25" and kinds("0f" * 11) == ""
    assert kinds("secret: " + "ab" * 12) == "assign:0:32,hex:8:32"
    assert kinds("é apikey:abcdef") == "assign:2:15"


def test_field_learns_and_adds():
    shape = secrets_crf.SHAPE
    key, sep, hexa, word, edge = (shape[x] for x in ("keyword", "separator", "long hex", "word", "edge"))
    codes = lambda *x: np.array(x, np.uint16).tobytes()
    secret = (codes(word, word, word, word, key, sep, hexa, word, word), bytes([0, 1, 2, 2, 0]), 5, 50)
    prose = (codes(edge, edge, edge, word, word, word, word, word, edge), bytes(5), 0, 50)
    lone = (codes(word, word, word, word, word, hexa, word, word, word), bytes([0, 0, 1, 0, 0]), 1, 20)
    field = secrets_crf.fit_field([secret, prose, lone], {})
    base, every = secrets_crf.Scanner(field)("some words then token ~ 0123456789ABCDEF01 and more")
    assert base == [] and [x for x in every if x[1] == 3]
    assert secrets_crf.Scanner(field)("plain words only here")[1] == []


#: Forms and harmless places that the field is not taught, with a value at {}.
UNSEEN = ("her passphrase stays {} since may", "sent it with bearer {} again", "credentials root {} open it", "type the password {} here", "a fresh api_key {} for you", "this auth token {} expires", "his private_key {} leaked out", "passwd of admin {} changed", "the secret , {} , is old", "pwd was {} then")
UNSEEN_HARMLESS = ("parcel {} came today", "flight {} is late", "the plate {} passed", "lot {} sold", "box {} and box", "a word like {} here", "they met at {} again", "stock {} rose", "the password was forgotten", "a secret smile and a token of love", "the key to it all is trust", "pages {} and more")


def secrets_and_others(seed):
    import random

    rng = random.Random(seed)
    fill = lambda: " ".join(rng.choices(["house", "river", "the", "of", "walk", "green", "and", "slow"], k=rng.randrange(2, 30)))
    out = []
    for i in range(400):
        value = secrets_crf.made_up_value(rng)
        form = rng.choice(UNSEEN_HARMLESS if i % 2 else UNSEEN)
        out.append((f"{fill()} {form.format(value)} {fill()}", None if i % 2 else value))
    return out


def quality(scan, rows):
    """Recall and precision of the field's spans."""
    hit = wrong = 0
    for text, value in rows:
        found = [text[a:b] for a, k, b in scan(text)[1] if k == 3]
        hit += value in found
        wrong += sum(x != value for x in found)
    return hit / sum(v is not None for _, v in rows), hit / max(1, hit + wrong)


def test_field_finds_planted_secrets_in_unseen_forms():
    words = {w: i for i, w in enumerate(secrets_crf.form_words(), 1)}
    scan = secrets_crf.Scanner(secrets_crf.fit_field(secrets_crf.examples(words), words))
    recall, precision = quality(scan, secrets_and_others(5))
    assert recall > 0.9 and precision > 0.95, (recall, precision)
    found = lambda t: [t[a:b] for a, k, b in scan(t)[1] if k == 3]
    assert found("please use the token Qw12Er34Ty56Ui78Op90 today") == ["Qw12Er34Ty56Ui78Op90"]
    assert found("the parcel Qw12Er34Ty56Ui78Op90 came today") == [] and found("a token of love and a secret smile") == []


def test_windows_of_long_texts_are_whole():
    import pyarrow as pa

    text = " ".join(["12"] * 1_000 + ["AKIA" + "A1" * 8])
    got = list(secrets_crf._windows({})([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])]))
    assert sum(sum(b.column("n").to_pylist()) for b in got) == 1_002
    assert any(1 in t for b in got for t in b.column("tags").to_pylist())


def test_windows_that_may_hold_missed_secrets_count_for_nothing():
    import pyarrow as pa

    tags = lambda t: {x for b in secrets_crf._windows({})([pa.RecordBatch.from_arrays([pa.array([t])], ["text"])]) for x in b.column("tags").to_pylist()}
    assert tags("the password is Qw12Er34Ty56Ui78Op90 here 12") == set() and tags("the parcel is Qw12Er34Ty56Ui78Op90 here 12")


# --- Mixing


def test_rake_meets_marginals():
    rng = np.random.default_rng(0)
    cells = [(s, l, t) for s in "abc" for l in "xy" for t in "pq"]
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    goals = []
    for d in range(3):
        totals = {v: sum(t for c, t in zip(cells, tokens) if c[d] == v) for v in {c[d] for c in cells}}
        goals.append(mixing.targets_of(totals, {"a": 0.6} if d == 0 else None, 0.5))
    w = mixing.rake(cells, tokens, goals)
    assert w.sum() == pytest.approx(tokens.sum())
    for d in range(3):
        for v, share in goals[d].items():
            assert sum(x for c, x in zip(cells, w) if c[d] == v) / w.sum() == pytest.approx(share, abs=1e-8)
    f = w / tokens
    c = mixing.calibrate(tokens, f, 0.4 * tokens.sum())
    assert (tokens * np.minimum(1, c * f)).sum() == pytest.approx(0.4 * tokens.sum(), rel=1e-9)


# --- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use the cookies of the web for that</div>
<article><h1>Head &amp; line</h1><p><b>First the words of a text that is long enough to be kept<br>and more.<div class="ad">Buy the thing now and be happy with it for all of the days</div><p>Short.</p>
<pre>  code
 x</pre><aside>By the way, this is an aside of the page and it is not for the text</aside><p>Second &eacute; paragraph with the usual words of a text, and it is long enough.</article>
<section id="comments"><article class="comment"><p>I am a reader and this is what I have to say about it all.</p></article></section>
<form><label>Name of the user</label></form><footer>&copy; all rights of the site</footer></body></html>"""


def test_main_text():
    assert html_blocks.main_text(PAGE).split("\n\n") == ["Head & line", "First the words of a text that is long enough to be kept and more.", "Short.", "code x", "Second é paragraph with the usual words of a text, and it is long enough."]


def test_main_text_without_marks():
    long = "This is the text of a page that has no marks at all, and it goes on for a while so that it is long enough to be of use to the reader who wants it. " * 2
    page = f"<div><a href=x>One</a> <a href=y>Two</a></div><p>{long}</p><p>Short one.</p><p>{long}</p><div><a>a</a><a>b</a><a>c</a></div>"
    assert html_blocks.main_text(page).split("\n\n") == [long.strip(), "Short one.", long.strip()]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a href='x", "<!-- never closed", "<script>x", "</p></div>", "&#xZZ; &bogus;", "<p>" * 5000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_blocks.main_text(page), str)


# --- Language


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<a " * 300_000, "<a \"x' " * 150_000 + ">", "<svg>" * 200_000, "<" * 1_000_000, "<!--" * 250_000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    html_blocks.main_text(page)
    assert time.perf_counter() - start < 5  # about 1 s a MB; quadratic scans took minutes


def test_media_elements_leave_the_rest_alone():
    words = "the cat of the house and the dog in it were here for that and so the rest of it was with them by the wall "
    assert html_blocks.main_text(f"<p>{words}<svg><svg>inner</svg>outer</svg>end</p>") == f"{words}end"
    for tag in ("video", "audio", "canvas", "object", "svg", "textarea", "noscript"):
        assert html_blocks.main_text(f"<p>{words}</p><{tag}><p>{words}</p>") == f"{words.strip()}\n\n{words.strip()}"
    assert html_blocks.main_text(f"<p>{words}</p><script>let the = of; and the is in to that it") == words.strip()


def test_only_letters_have_a_language():
    model = langid.solve(np.eye(4, dtype=np.uint8), ["a", "b", "a", "b"], np.zeros(1 << langid.BITS, np.int16))
    langs, scores = model.score(["½", "² ①", "Ⅷ", "12 _", "x", "ª", "ℵ"])
    assert langs[:4] == ["und"] * 4 and scores[:4] == [0.0] * 4 and all(x in "ab" for x in langs[4:])



def test_kernel_model_is_the_folded_kernel():
    rng = random.Random(0)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    texts, langs = [make("abcde") for _ in range(40)] + [make("vwxyz") for _ in range(40)], ["one"] * 40 + ["two"] * 40
    place = np.zeros(1 << langid.BITS, np.int16)
    grams = np.unique(np.concatenate([h for t in texts for h in langid.hashed(t)]))[:2000]
    place[grams] = np.arange(1, len(grams) + 1)
    flags = langid.presence(texts, place, len(grams))
    model = langid.solve(flags, langs, place, landmarks=16)
    got, scores = model.score([make("abcde"), make("vwxyz"), "", "123 !!"])
    assert got == ["one", "two", "und", "und"] and scores[2] == 0.0 and 0.5 < scores[0] <= 1


def test_scores_are_those_of_the_kernel_itself():
    """The kernel of every pair, the Nystrom map, the ridge and the soft maximum, each by its plain formula."""
    rng = random.Random(3)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(rng.randrange(5, 25)))
    kinds = ["aa", "bb", "cc"]
    langs = [kinds[i % 3] for i in range(45)]
    texts = [make({"aa": "abcde", "bb": "cdefg", "cc": "efgha"}[v]) for v in langs]
    place = np.zeros(1 << langid.BITS, np.int16)
    known = np.unique(np.concatenate([h for t in texts for h in langid.hashed(t)]))[::2][:3000]
    place[known] = np.arange(1, len(known) + 1)
    grams = lambda t: {int(g) for h in langid.hashed(t) for g in h} & set(known.tolist())
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(max(1, len(grams(a))) * max(1, len(grams(b))))
    marks, ridge = [texts[i] for turn in range(4) for i in range(3 * turn, 3 * turn + 3)], 1e-2
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(k_mm)
    keep = value > 1e-6 * value.max()
    inverse_root = vector[:, keep] / np.sqrt(value[keep])
    phi = lambda t: np.array([kernel(t, z) for z in marks]) @ inverse_root
    x, y = np.array([phi(t) for t in texts]), np.array([[1.0 if v == k else -1.0 for k in kinds] for v in langs])
    a = np.linalg.solve(x.T @ x + ridge * len(texts) * np.eye(x.shape[1]), x.T @ y)
    flags = langid.presence(texts, place, len(known))
    model = langid.solve(flags, langs, place, landmarks=12, ridge=ridge)
    fresh = [make("abcde"), make("cdefg"), make("efgha"), make("acg")]
    got, scores = model.score(fresh)
    for t, lang, score in zip(fresh, got, scores, strict=True):
        p = np.exp(langid.SHARPNESS * (phi(t) @ a))
        p /= p.sum()
        assert lang == kinds[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-3)


def test_presence_reads_whole_texts():
    assert len(set(map(int, np.concatenate(langid.hashed("ab" * 10 + "zq"))))) > len(set(map(int, np.concatenate(langid.hashed("ab" * 10)))))


# --- Toxicity


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, toxicity.FEATURES))
    y = (((x[:, 2] > 0.5) & (x[:, 5] < 1)) ^ (rng.random(2000) < 0.05)).astype(float)
    trees = toxicity.boost(x[:1200], y[:1200])
    raw = trees.raw(x[1200:])
    assert ((raw > 0) == (y[1200:] > 0)).mean() > 0.88
    knots, values = toxicity.isotonic(raw, y[1200:])
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= -1e-12).all() and 0 < values[0] < values[-1] < 1


def test_trees_and_calibration_equal_plain_versions():
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(300, toxicity.FEATURES)), 2), (rng.random(300) < 0.4).astype(float)
    trees = toxicity.boost(x, y)

    def walk(row, f, t, v):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(row[f[at]] > t[at])
        return v[at - len(f)]

    plain = [trees.start + sum(walk(row, f, t, v) for f, t, v in zip(trees.feature, trees.threshold, trees.value)) for row in x[:50]]
    assert np.allclose(trees.raw(x)[:50], plain)
    raw = np.round(rng.normal(size=80), 1)
    knots, values = toxicity.isotonic(raw, y[:80])
    # The greatest convex minorant of the sums over distinct scores, by its definition.
    levels = np.unique(raw)
    n, s = np.array([(raw == r).sum() for r in levels]), np.array([y[:80][raw == r].sum() for r in levels])
    fit = [max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(levels))) for a in range(i + 1)) for i in range(len(levels))]
    pools = {}
    for i, v in enumerate(fit):
        pools.setdefault(round(v, 12), []).append(i)
    prior = y[:80].mean()
    want = np.maximum.accumulate([(s[p].sum() + prior) / (n[p].sum() + 1) for p in pools.values()])
    assert np.allclose(values[::2], want) and np.allclose(knots, [levels[i] for p in pools.values() for i in (p[0], p[-1])])


def plain_features(text, lexicon):
    """Densities and counts by a loop over tokens, in the order of the features where those are plain."""
    tokens = text.split()
    core = [t.strip(toxicity.EDGES) for t in tokens]
    low = [c.lower() for c in core]
    insult = [w in toxicity.INSULTS for w in low]
    learnt = [lexicon.weight(w)[0] >= toxicity.WORD for w in low]
    begin = [lexicon.weight(w)[1] >= toxicity.BEGIN for w in low]
    you = [w in toxicity.SECOND for w in low]
    caps = [len(c) > 1 and c.isupper() for c in core]
    odd = [bool(c) and not c.isalpha() and any(x.isalpha() for x in c) for c in core]
    letters = lambda w: "".join(x for x in w if x.isalpha())
    hidden = [o and (letters(w.translate(toxicity.LEET)) in toxicity.INSULTS or letters(w.translate(toxicity.LEET)) in lexicon.words or letters(w) in toxicity.INSULTS) for o, w in zip(odd, low)]
    loud = [t[-1] in "!?" for t in tokens]
    hits = [i for i in range(len(tokens)) if insult[i] or learnt[i] or begin[i] or hidden[i]]
    near = sum(any(you[j] and abs(i - j) <= 5 for j in range(len(tokens))) for i in hits)
    n = len(tokens)
    counts = [sum(m) for m in (insult, learnt, begin, you, caps, odd, hidden, loud)]
    return [*(c / n for c in counts), *(float(counts[i]) for i in (0, 1, 2, 6)), len(hits) / n, float(len(hits)), near / max(1, len(hits)), float(near)]


def test_features_equal_a_plain_version():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"grumbl": 4.0, "meh": 1.5}, {"zork": 4.0, "abcd": 1.3})
    words = ["you", "YOU,", "idiot", "1d10t", "i.d.i.o.t", "Grumbl!", "zorkish", "meh", "abcdef", "plain", "LOUD", "x7", "!!", "...", "dich", "a", "m0r0n?"]
    for n in (1, 3, 20, 199, 200, 400):
        text = " ".join(rng.choices(words, k=n))
        assert toxicity.features(text, toxicity.Marks(lexicon))[:16] == pytest.approx(plain_features(text, lexicon))
        assert toxicity.features(text, toxicity.Marks(lexicon))[19] == pytest.approx(sum(len(t) == 1 for t in text.split()) / n)


def test_features_see_obfuscation_and_proximity():
    marks = toxicity.Marks(toxicity.Lexicon({"grumbl": 4.0}, {"zork": 4.0}))
    f = lambda t: toxicity.features(t, marks)
    assert f("") == [0.0] * toxicity.FEATURES
    assert f("you are an 1d10t !")[6] > 0 and f("an i.d.i.o.t here")[6] > 0
    assert f("you IDIOT!!")[0] == 0.5 and f("you idiot")[14] == 1.0 and f("zorkisch")[2] == 1.0


# --- Suffix tree


def test_states_are_distributions():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 5, 20_000)
    seq[1::2] = (seq[0::2] + 1) % 5
    levels = [{}] + [dict() for _ in range(pst.DEPTH)]
    seq = seq.astype(np.int32)
    code = pst.codes(seq)
    for k in range(1, pst.DEPTH + 1):
        for c, s in zip(code % pst.SIZE**k, seq):
            levels[k].setdefault(int(c), np.zeros(pst.SIZE))[s] += 1
    root = np.bincount(seq, minlength=pst.SIZE) + 0.5
    root = root / root.sum()
    tree = pst.grow(pst.Classes({}, {}), root, levels)
    p = 10.0 ** tree.lift * root
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3) and tree.contexts > 1
    assert tree.score(seq) > 0


# --- BPE


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return bpe.codec(path), Tokenizer.from_file(path)


def test_automaton_equals_the_library(tokenizer):
    mine, theirs = tokenizer
    rng = random.Random(0)
    texts = ["", "  ", "I'll don't THE's", "aaaa aaaaaa aaaaaaaaaaaaa", "<|endoftext|>a<|startoftext|>", "ΟΔΟΣ ǅ ﬁ İ Straße é", "a\x1cb\x85c　d", "1234½² 😀😀 ——!!!???", "\x00\x01"]
    texts += ["".join(rng.choice("aeinrst'. !9éß中😀A") for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == want, t
        assert mine.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_a_word_is_read_once(tokenizer):
    """Arcs come from what the symbols read so far end in, not from looking up every stretch of the word."""
    cut = []

    class Word(str):
        def __getitem__(self, at):
            cut.append(at)
            return super().__getitem__(at)

    automaton = tokenizer[0].automaton
    for w in ("internationalization", "qzxwvkjqzxwvkj", "aaaaaaaaaaaaaaaaaaaaa", "e", ""):
        assert automaton.encode(Word(w)) == automaton.encode(w) and len(cut) <= len(w)  # more than that before
        cut.clear()


# --- Joins of sets


def planted(rng, n, rule):
    """Texts with near copies around the threshold, shared passages, short ones and equal ones."""
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)] + ["the", "of", "a"] * 60
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    out = []
    while len(out) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 9, 15, 40, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(words)
            for _ in range(rng.randrange(0, max(1, len(w) // 40) + 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w) + (" " + passage if rng.random() < 0.2 else ""))
    return out[:n]


def test_similar_sets_share_a_signature():
    rng = random.Random(3)
    for rule in (partenum.Rule(4, 85), partenum.Rule(5, 80)):
        frequent = frozenset({b"the", b"of", b"a"})
        bands = partenum.Bands(rule)
        texts = planted(rng, 250, rule)
        held = [partenum.shingles(t, rule.words, frequent) for t in texts]
        sigs = [set(partenum.signatures(f, bands, c).tolist()) for f, c in held]
        linked = 0
        for i in range(len(texts)):
            for j in range(i):
                a, b = held[i][0], held[j][0]
                if len(a) and len(b) and rule.linked(len(a), len(b), len(np.intersect1d(a, b))) and not np.array_equal(a, b):
                    linked += 1
                    assert sigs[i] & sigs[j]
        assert linked > 50


def test_parity_never_exceeds_the_differences():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**60, 300).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.integers(0, 40) :], rng.integers(0, 2**60, rng.integers(0, 60)).astype(np.uint64))))
        x, y = (np.frombuffer(partenum.parity(s, 40), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_spanning_forest_keeps_components():
    rng = np.random.default_rng(0)
    for same in (True, False):
        for _ in range(60):
            n, m = rng.integers(1, 25), rng.integers(1, 25)
            m = n if same else m
            g = rng.random((n, m)) < 0.08
            if same:
                g = g | g.T
            near = lambda side, x, others: g[x, others] if side == 0 or same else g[others, x]  # noqa: E731, B023
            edges = list(partenum.spanning(n, m, same, near))
            at = lambda side, x: x if same or side == 0 else n + x  # noqa: E731, B023

            def parts(pairs):
                root = list(range(n if same else n + m))  # noqa: B023

                def find(x):
                    while root[x] != x:
                        x = root[x]
                    return x

                for i, j in pairs:
                    root[find(at(0, i))] = find(at(1, j))  # noqa: B023
                return [find(x) for x in range(len(root))]

            whole, kept = parts(np.argwhere(g).tolist()), parts(edges)
            assert all((whole[a] == whole[b]) == (kept[a] == kept[b]) for a in range(len(whole)) for b in range(a))
            assert all(g[i, j] for i, j in edges)


# --- Neighbours


def test_strings_and_their_probes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    hashes = lsh_forest.Hashes(x.mean(axis=0), 4, 7)
    own, probe = hashes(x, True)
    flipped = own ^ probe
    assert (own == hashes(x)[0]).all() and own.max() < 2**lsh_forest.BITS
    assert all(bin(f).count("1") == 1 and f >= 2 ** (lsh_forest.BITS - lsh_forest.PROBE) for f in flipped.ravel().tolist())
    side = np.abs((x - x.mean(axis=0)) @ hashes.planes).reshape(50, 4, lsh_forest.BITS)[:, :, : lsh_forest.PROBE]
    assert (np.log2(flipped).astype(int) == lsh_forest.BITS - 1 - side.argmin(axis=2)).all()


def test_bounds_are_those_of_shared_prefixes():
    rng = np.random.default_rng(1)
    codes, of = np.sort(rng.integers(0, 2**lsh_forest.BITS, 300)), rng.integers(0, 2**lsh_forest.BITS, 20)
    for open_ in (0, 3, 25, 28, lsh_forest.BITS):
        lo, hi = lsh_forest._bounds(codes, of, open_)
        assert [(codes >> open_ == q >> open_).sum() for q in of] == (hi - lo).tolist()


PROSE = "This is the text of the article and it has many of the words that are in it, of which there are more to come. "


@pytest.mark.parametrize(
    "page",
    [
        "<form><nav>menu words</nav><article><p>{0}</p></article></form>",
        "<div class='social-science'><article><p>{0}</p></article></div>",
        "<body><div id='hidden-gems'><main><p>{0}</p></main></div><aside><article><p>Teaser of another one, that is to be left out of it</p></article></aside></body>",
        "<form action='/x'><p>{0}</p><input><button>Send</button></form>",
        "<div class='popular-science'><p>{0}</p></div><div class='cookie-notice'><p>We use cookies and you have to agree to all of them if you are to read on here.</p></div>",
        "<article><p class='related'>{0}</p></article>",
        "<article><p>{0}</p><p class='related'>Related: <a href=x>one</a> <a href=y>two</a> <a href=z>three</a></p><div class='share'>Share this</div></article>",
        "<article><p>{0}<button>Click</button></p><label>Name</label><form><p>Sign up for it</p></form></article>",
    ],
)
def test_articles_in_odd_surroundings_are_whole(page):
    text = (PROSE * 3).strip()
    assert html_blocks.main_text(page.format(text)) == text


def test_teasers_in_sidebars_stay_out():
    assert html_blocks.main_text(f"<aside><article><p>{PROSE * 3}</p></article></aside>") == ""
    page = f"<article><p>{PROSE}</p></article><div class='related'><article><p>{PROSE * 3}</p></article></div>"
    assert html_blocks.main_text(page) == PROSE.strip()


def plain_passes(blocks):
    """Both passes over (text, characters in links, links, in content), each block against all others."""
    marked = any(b[3] for b in blocks)
    first = []
    for text, linked, links, content in blocks:
        words = [w.strip(".,;:!?()[]\"'«»*#%&$") for w in text.lower().split()]
        stops, size, density = sum(w in html_blocks.STOP_WORDS for w in words) / len(words), len(text), linked / len(text)
        if marked and not content:
            label = False
        elif density > 0.5 and (links > 2 or not content):
            label = False
        elif content:
            label = True if size >= 70 and (stops >= 0.1 or size >= 200) and density <= 0.5 else None
        elif size < 70:
            label = False if linked else None
        elif stops >= 0.3:
            label = True if size > 200 or density < 0.2 else None
        else:
            label = None if stops >= 0.1 else False
        first.append(label)
    out = []
    for i, label in enumerate(first):
        if label is None:
            content = blocks[i][3]
            sides = [next((j for j in side if first[j] is not None), None) for side in (range(i - 1, -1, -1), range(i + 1, len(blocks)))]
            near = [(abs(i - j), first[j]) for j in sides if j is not None and blocks[j][3] == content]
            closest = {lab for d, lab in near if d == min(near)[0]}
            label = (content if len(closest) > 1 else closest.pop()) if near else content
        out.append(label)
    return "\n\n".join(b[0] for b, keep in zip(blocks, out) if keep)


def test_passes_equal_a_plain_version():
    rnd = random.Random(11)
    for _ in range(400):
        blocks, html, content = [], "", rnd.random() < 0.5
        for part in range(3):
            inside = content and part == 1
            html += "<article>" if inside else ""
            for _ in range(rnd.randrange(9)):
                words = [rnd.choice(["the", "of", "and", "it", "house", "river", "42", "green", "table"] if rnd.random() < 0.6 else ["house", "river", "42", "green"]) for _ in range(rnd.choice([2, 5, 14, 30, 60]))]
                n = rnd.choice([0, 0, 0, 1, 2, 4])
                links = [i < len(words) for i in range(n)] and sorted(rnd.sample(range(len(words)), min(n, len(words))))
                text = " ".join(words)
                blocks.append((text, sum(len(words[i]) for i in links), len(links), inside))
                html += "<p>" + " ".join(f"<a href=x>{w}</a>" if i in links else w for i, w in enumerate(words)) + "</p>"
            html += "</article>" if inside else ""
        assert html_blocks.main_text(html) == plain_passes(blocks)
