"""Quality, language-model and URL scores, personal data: held-out accuracy and brute force."""

import math
import random
import re
import zlib
from collections import Counter

from impactloom.llm import lm_score, pii, quality, url_filter
from impactloom.llm.common import table

from .messy import documents, labels, pages

MEDIUM = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs, known = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    rows = quality.score(docs, known).join(known, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = [[r["score"] for r in held if r["quality"] == q] for q in (1, 0)]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9
    assert sum(r["predicted"] for r in held if r["quality"] == 1) / len(good) > 0.95


def test_discriminant_equals_brute_force():
    """Log densities by determinants and inverses in place of Cholesky factors."""
    import numpy as np

    rng = np.random.default_rng(8)
    rows = {c: rng.normal(c, 1 + c, (60 + 40 * c, quality.STATS)) @ rng.normal(0, 1, (quality.STATS, quality.STATS)) for c in (0, 1)}
    z = {c: np.hstack([np.ones((len(x), 1)), x]) for c, x in rows.items()}
    model = quality.Discriminant({c: m.T @ m for c, m in z.items()})
    every = np.vstack(list(rows.values()))
    common, logs = np.cov(every.T, bias=True), []
    scale = np.sqrt(np.diag(common))
    unit = np.outer(scale, scale)
    for c in (0, 1):
        own = np.cov(rows[c].T, bias=True) / unit
        s = (1 - quality.POOL - quality.RIDGE) * own + quality.POOL * common / unit + quality.RIDGE * np.eye(quality.STATS) * max(np.trace(own) / quality.STATS, 0.05)
        d = (every - rows[c].mean(axis=0)) / scale
        logs.append(np.log(len(rows[c]) / len(every)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.scores(every), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_quality_statistics_are_the_models_only_input(spark, monkeypatch):
    """The bound of the labelled rows holds, and a model on a sample still scores all rows."""
    docs, known = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    monkeypatch.setattr(quality, "TRAIN_ROWS", 100)
    assert 60 <= quality.training_labels(known).count() <= 140
    assert quality.score(docs, known).count() == docs.count()


def test_quality_of_messy_rows(spark):
    rows = quality.score(documents(spark), labels(spark)).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False, False]
    assert {r["score"] for r in quality.score(documents(spark), labels(spark, [])).collect()} == {0.5}
    assert quality.score(documents(spark, []), labels(spark)).collect() == []
    kept = quality.keep_good(documents(spark), labels(spark, []))
    assert kept.columns == documents(spark).columns and kept.count() == 12


def brute_losses(docs, target):
    """The two models with dictionaries in place of hashed tables."""
    words = {d: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for d, t in docs}
    out = {}
    models = []
    for chosen in (set(words), target):
        uni, bi = Counter(), Counter()
        for d in chosen:
            w = words[d]
            uni.update([None, *w] if w else [])
            bi.update(zip([None, *w], w, strict=False))
        models.append((uni, bi, sum(uni.values())))
    v = len({x for w in words.values() for x in w}) + 1
    for d, w in words.items():
        losses = []
        for uni, bi, n in models:
            total = 0.0
            for before, x in zip([None, *w], w, strict=False):
                p = lm_score.MIX * bi[before, x] / max(uni[before], 1) + (1 - lm_score.MIX) * (uni[x] + 0.5) / (n + v / 2)
                total -= math.log(p)
            losses.append(total)
        out[d] = (len(w), *losses)
    return out


def test_language_model_equals_brute_force(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["Red", "green", "blue", "x" + str(r.randrange(30))]) for _ in range(r.randrange(2, 60)))) for i in range(60)]
    target = {d for d, _ in docs if d % 3 == 0}
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    got = {x["doc_id"]: x for x in lm_score.score(df, spark.createDataFrame([(d,) for d in target], "doc_id long")).collect()}
    want = brute_losses(docs, target)
    for d, (n, background, wanted) in want.items():
        x = got[d]
        assert x["n_tokens"] == n
        assert abs(x["background_loss"] * n - background) < 1e-3 and abs(x["target_loss"] * n - wanted) < 1e-3
        assert abs(x["score"] - (x["background_loss"] - x["target_loss"])) < 1e-9


def test_language_model_keeps_words_and_pairs_apart(spark, monkeypatch):
    """More words and pairs than any table of 2^18 slots keeps apart, over several blocks."""
    monkeypatch.setattr(lm_score, "BLOCK", 400_000)
    docs = [(i, " ".join(f"w{j}" for j in range(i * 4_000, i * 4_000 + 5_000))) for i in range(50)]
    target = {d for d, _ in docs if d % 4 == 0}
    got = {x["doc_id"]: x for x in lm_score.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(d,) for d in target], "doc_id long")).collect()}
    for d, (n, background, wanted) in brute_losses(docs, target).items():
        assert got[d]["n_tokens"] == n
        assert abs(got[d]["background_loss"] - background / n) < 1e-6 and abs(got[d]["target_loss"] - wanted / n) < 1e-6


def test_language_model_probabilities_sum_to_one(spark):
    """Over the vocabulary, after any word that was seen: scored as documents of one word each are not enough, so by the brute-force model."""
    docs = [(i, f"a{i % 3} b{i % 5} a{i % 2}") for i in range(30)]
    words = sorted({w for _, t in docs for w in t.split()})
    uni, bi = Counter(), Counter()
    for _, t in docs:
        w = t.split()
        uni.update([None, *w])
        bi.update(zip([None, *w], w, strict=False))
    n, v = sum(uni.values()), len(words) + 1
    singles = [(1000 + i, w) for i, w in enumerate(words)]
    got = {x["doc_id"]: x["background_loss"] for x in lm_score.score(spark.createDataFrame(docs + singles, "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).collect()}
    uni.update([None] * len(words) + words)
    bi.update([(None, w) for w in words])
    n += 2 * len(words)
    rest = (1 - lm_score.MIX) * (uni[None] + 0.5) / (n + v / 2)  # the beginning is a word too, which follows nothing
    assert abs(sum(math.exp(-got[i]) for i, _ in singles) + rest - 1) < 1e-9


def test_language_model_of_messy_rows(spark):
    rows = lm_score.score(documents(spark), labels(spark).select("doc_id")).collect()
    assert len(rows) == 12
    assert all(r["score"] == 0 for r in rows if r["n_tokens"] == 0) and sum(r["n_tokens"] == 0 for r in rows) == 4
    assert lm_score.score(documents(spark, []), labels(spark)).collect() == []
    assert lm_score.score(documents(spark), labels(spark, [])).count() == 12


RULES = [(h + p, h, p, v) for h, p, v in url_filter.RULES]


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(n), n, v) for n, h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_rules_equal_brute_force(spark):
    urls = ["http://Example.com/en/x?q#f", "https://www.example.com/en/", "http://a.example.com/en", "x", None, "", "ftp://net/es/1", "http://b.net/fr/", "http://notnet/fr/", "http://com", "http://com/", "http://q.org?x=/en/", "http://É.net/es/ü", "http://x.www.example.com/en/a://b"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, None, None), (0, urls[0], None)]
    got = url_filter.judge(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            continue
        host, path, rule, verdict = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(pages(spark, [])).collect() == []


def test_url_scores_equal_brute_force(spark):
    """Witten-Bell by dictionaries over the whole URLs, query included, that the filter may learn from."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(5))
    urls = [f"http://{word()}.com/{word()}?q={word()}" for _ in range(60)] + [f"https://{word()}.net/fr/{word()}#{word()}" for _ in range(60)] + [f"http://x.org/{word()}?{word()}" for _ in range(20)] + [None, "", "HTTP://É.org/_"]
    df = pages(spark, [(i, u, None) for i, u in enumerate(urls)])
    held = {x["page_id"] for x in df.selectExpr("page_id", "pmod(xxhash64(coalesce(url, '')), 5) = 0 AS held").collect() if x["held"]}
    code = lambda b: {**{c: i + 1 for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789.-/")}}.get(b, url_filter.SYMBOLS - 1)
    coded = [[0] * url_filter.ORDER + [code(b) for b in (u or "").encode().lower()] + [0] for u in urls]
    models = {}
    for verdict in ("allow", "block"):
        follow = {}
        for i, u in enumerate(urls):
            if i not in held and brute_url(u)[3] == verdict:
                for at in range(url_filter.ORDER, len(coded[i])):
                    for order in range(url_filter.ORDER + 1):
                        follow.setdefault(tuple(coded[i][at - order : at]), Counter())[coded[i][at]] += 1
        models[verdict] = follow

    def p(follow, context, symbol):
        lower = p(follow, context[1:], symbol) if context else 1 / url_filter.SYMBOLS
        seen = follow.get(context)
        return (seen[symbol] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    for x in url_filter.judge(df).collect():
        c, own = coded[x["page_id"]], range(url_filter.ORDER, len(coded[x["page_id"]]))
        want = sum(math.log(p(models["allow"], tuple(c[at - url_filter.ORDER : at]), c[at])) - math.log(p(models["block"], tuple(c[at - url_filter.ORDER : at]), c[at])) for at in own) / len(own)
        assert abs(x["score"] - want) < 1e-5


def test_url_model_separates_what_rules_do_not_reach(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"http://{word()}.com/shop/{word()}", None) for i in range(400)] + [(1000 + i, f"http://{word()}.net/es/casino-{word()}", None) for i in range(400)]
    rows += [(5000 + i, f"http://{word()}.org/shop/{word()}", None) for i in range(40)] + [(6000 + i, f"http://{word()}.org/es/casino-{word()}", None) for i in range(40)]
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge(pages(spark, rows)).collect()}
    assert sum(got[5000 + i] == "allow" for i in range(40)) >= 36
    assert sum(got[6000 + i] == "block" for i in range(40)) >= 36


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_brute_force():
    r = random.Random(11)
    parts = ["a@b.co", "x.y@", "@z.org", "1.2.3.4", "300.1.1.1.1", "12.34", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+4", " ", "é", "😀", "-", ".", "..", "0001.02.3.4", "q@w-e.r-t.yz", "%+", "007", "\n", "+49 30 1234567", "@", "a@b"]
    for _ in range(4_000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        assert pii.base_spans(text) == brute_base(text), text


def test_bootstrapping_finds_what_patterns_miss(spark):
    seeds = [(i, f"please write to user {i}: mail me at person{i}@site{i}.org today") for i in range(8)]
    hidden = [(100, "please write to user 7: mail me at person(at)site9.org today"), (101, "the 4 bridges were built in 1874 by hand")]
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(seeds + hidden, "doc_id long, text string")).collect()}
    text = hidden[0][1]
    start = text.index("person(at)")
    assert rows[100]["spans"] == f"email:{start}:{start + len('person(at)site9.org')}" and rows[100]["n_email"] == 0
    assert rows[101]["spans"] == ""
    assert all(rows[i]["spans"] == rows[i]["base"] and rows[i]["n_email"] == 1 for i in range(8))


def test_bootstrapping_keeps_what_is_sure_and_what_is_long(spark):
    """A word in so many trusted contexts that its confidence is 1 in doubles, and one of over 64 characters."""
    seeds = [(100 * c + i, f"and ask{c} at{c} person{i}@site{i}.org today{c}") for c in range(10) for i in range(30)]
    sure, long = "person(at)site9.org", "x" * 80 + "(at)site9.org"
    hidden = [(5000 + c, f"and ask{c} at{c} {sure} today{c}") for c in range(10)] + [(6000, f"and ask0 at0 {long} today0")]
    rows = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(seeds + hidden, "doc_id long, text string")).collect()}
    for i, text in hidden:
        start = len(text.rsplit(" ", 2)[0]) + 1
        assert rows[i] == f"email:{start}:{start + len(long if i == 6000 else sure)}"


def brute_secret(text, s, e):
    value, before = text[s:e], text[:s].lower().rstrip("\"'`")
    if len(value) < 16 or not re.fullmatch("[A-Za-z0-9+/_.~=-]+", value) or not re.search("[A-Za-z]", value) or not re.search("[0-9]", value):
        return False
    if len(text[:s]) - len(before) > 1:
        return False
    before = before.rstrip()
    sign = next((x for x in ("=>", ":=", "=", ":") if before.endswith(x)), None)
    if sign is None:
        return False
    name = before[: -len(sign)].rstrip()
    name = name[:-1] if name[-1:] in ("\"", "'", "`") else name
    name = name[:-1] if name.endswith("s") else name
    plain = ["password", "passwd", "pwd", "secret", "token", "credential"]
    return any(name.endswith(n) for n in plain + [k + c + "key" for k in ("api", "access", "private", "auth", "secret") for c in ("", " ", "_", "-")])


def brute_shape(name):
    if all(c in "0123456789" for c in name):
        return f"num{len(name)}"
    if all(c in "0123456789abcdefABCDEF" for c in name):
        return f"hex{len(name)}"
    out = ""
    for c in name:
        out += "w" * (not out.endswith("w")) if c.isalnum() else c
    return out


def brute_spans(docs):
    """Base, secret and discovered spans with dictionaries; candidates and contexts by splitting at blanks."""
    found = []
    for d, text in docs:
        base = brute_base(text)
        spans = [(s, e, k) for s, k, e in base]
        for m in re.finditer(r"\S+", text):
            s, e = m.span()
            if not re.search("[0-9@]", m[0]) or any(a < e and b > s for a, b, _ in spans[: len(base)]):
                continue
            e -= len(m[0]) - len(m[0].rstrip(".,;:!?)]}\"'*&$%#|"))
            while s < e and text[s] in "([{\"'*&$%#|":
                s += 1
            sign = re.search("=>|:=|=|:", text[s:e])
            if sign and re.fullmatch("[A-Za-z_][A-Za-z0-9_.-]*[\"'`]?", text[s : s + sign.start()]) and not text[s + sign.start() : e].startswith("://"):
                value = s + sign.end() + (text[s + sign.end() : s + sign.end() + 1] in tuple("\"'`"))
                s = value if e - value >= 4 else s
            if e - s >= 4:
                spans.append((s, e, 4 if brute_secret(text, s, e) else None))
        for s, e, k in spans:
            before, after = ["^", "^", *text[:s].lower().split()], [*text[e:].lower().split(), "$"]
            found.append((d, s, e, k, text[s:e].lower(), {f"{before[-2]} {before[-1]} _", f"{before[-1]} _ {after[0]}", f"{before[-1]} <{brute_shape(text[s:e]).lower()}>"}))
    kinds, around = {}, {}
    for _, _, _, k, name, contexts in found:
        for c in contexts:
            around.setdefault(c, {}).setdefault(name, None)
            if k is not None:
                around[c][name] = max(k, -1 if around[c][name] is None else around[c][name])
                kinds.setdefault(name, set())
    for names in around.values():
        for name, k in names.items():
            if k is not None:
                kinds[name].add(k)
    known = {(n, k): 1.0 for n, ks in kinds.items() for k in ks}
    for _ in range(pii.ROUNDS):
        belief = {}
        for c, names in around.items():
            for k in range(5):
                held = [known[n, k] for n in names if (n, k) in known]
                if len(held) >= pii.SUPPORT and sum(held) / (len(names) + 1) >= pii.SURE:
                    belief[c, k] = sum(held) / (len(names) + 1)
        sure = {}
        for (c, k), x in belief.items():
            for n, seed in around[c].items():
                if seed is None:
                    sure[n, k] = sure.get((n, k), 0.0) - math.log1p(-min(x, 0.999))
        known = {x: 1 - math.exp(-v) for x, v in sure.items()} | {(n, k): 1.0 for n, ks in kinds.items() for k in ks}
    best = {}
    for (n, k), v in sure.items():
        if 1 - math.exp(-v) >= pii.ACCEPT:
            best[n] = max(best.get(n, (-1, 0, -9)), (1 - math.exp(-v), round(v, 9), -k))
    best |= {n: (1, math.inf, -4) for n, ks in kinds.items() if 4 in ks}
    out = {}
    for d, s, e, k, name, _ in found:
        if k is not None or name in best:
            out.setdefault(d, []).append((s, k if k is not None else -best[name][2], e))
    return {d: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out.get(d, []))) for d, _ in docs}


def test_bootstrapping_equals_brute_force(spark):
    r = random.Random(17)
    frames = ["mail me at {} today", "call {} now", "server {} is down", "my card {} please", "reach him via {} or not", "x{} y", 'the token = "{}" here', "key={} of"]
    values = [lambda i: f"u{i}@h{i % 3}.org", lambda i: f"user{i}(at)host", lambda i: f"10.0.{i}.7", lambda i: f"host-{i}", lambda i: f"+49 30 {1000000 + i}", lambda i: f"0049-30-{i}", lambda i: f"id{i:04d}", lambda i: "z" * 70 + str(i), lambda i: f"({i}@).", lambda i: f"{i:08x}" * 3 + "a1", lambda i: f"Ab{i:014d}"]
    discovered = 0
    for _ in range(3):
        docs = []
        for d in range(150):
            favoured = r.randrange(len(frames))
            parts = [frames[favoured if r.random() < 0.8 else r.randrange(len(frames))].format(values[(2 * favoured + (r.random() < 0.2)) % len(values)](r.randrange(12))) for _ in range(r.randrange(1, 5))]
            docs.append((d, r.choice([" ", "\n", " and "]).join(parts)))
        want = brute_spans(docs)
        got = {x["doc_id"]: (x["spans"], x["base"]) for x in pii.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
        assert {d: s for d, (s, _) in got.items()} == want
        discovered += sum(s != b for s, b in got.values())
    assert discovered >= 5


def test_contexts_are_whole_words():
    text = "a" * 500 + " " + "b" * 300 + " me@x.org " + "c" * 200
    start = text.index("me@")
    first, second, third = pii.patterns(text, start, start + 8)
    assert first == f"{pii._known('a' * 500)} {pii._known('b' * 300)} _" and second == f"{pii._known('b' * 300)} _ {pii._known('c' * 200)}"
    assert third == f"{pii._known('b' * 300)} <w@w.w>"
    assert pii.patterns("me@x.org", 0, 8) == ["^ ^ _", "^ _ $", "^ <w@w.w>"]


def test_secrets_under_unknown_names(spark):
    """Values of known names induce patterns that find values of names nobody listed; plain text and plain hex digits stay alone.

    A pattern counts from SURE on: with 40 unknown names beside 60 known ones it must not.
    """
    r = random.Random(4)
    key = lambda: f"{r.getrandbits(160):040x}"
    lead = lambda: " ".join(r.choice(["the", "house", "stands", "by", "old", "river"]) for _ in range(r.randrange(3, 20)))
    known = [(i, f'{lead()} token = "{key()}" {lead()}') for i in range(60)]
    plain = [(200 + i, f"{lead()} commit {key()} of 1874, 4 bridges, ratio = 0.75 and {lead()}") for i in range(60)]
    place = lambda text: f"secret:{text.index(chr(34)) + 1}:{text.index(chr(34)) + 41}"
    for n, least, most in ((20, 0.9, 1), (40, 0, 0)):
        hidden = [(100 + i, f'{lead()} {r.choice(["sid", "schluessel", "clef", "session"])} = "{key()}" {lead()}') for i in range(n)]
        rows = {x["doc_id"]: x["spans"] for x in pii.find(spark.createDataFrame(known + hidden + plain, "doc_id long, text string")).collect()}
        assert all(place(text) in rows[i].split(",") for i, text in known)
        assert least <= sum(place(text) in rows[i].split(",") for i, text in hidden) / n <= most
        assert not [rows[i] for i, _ in plain if "secret" in rows[i]]


def test_a_secret_is_known_wherever_it_stands_again(spark):
    value = "aZ9" * 8
    docs = [(1, f"api_key: {value}"), (2, f"somebody wrote {value}, no more"), (3, f"password={'x' * 30}"), (4, "token: short1")]
    rows = {x["doc_id"]: x["spans"] for x in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: "secret:9:33", 2: "secret:15:39", 3: "", 4: ""}


def test_personal_data_of_messy_rows(spark):
    rows = pii.find(documents(spark)).collect()
    assert len(rows) == 12
    assert {r["doc_id"]: r["base"] for r in rows}[8] == "email:11:20"
    assert {r["base"] for r in rows if r["doc_id"] in (4, 5, 7)} == {""}
    assert pii.find(documents(spark, [])).collect() == []
