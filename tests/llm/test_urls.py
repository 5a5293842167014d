import hashlib
import math
import random

from tagweave.llm import urls as U

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def model_ratio(examples, gram):
    """Witten-Bell from the shortest context on."""
    out = []
    for c in ("allow", "block"):
        p = 1 / U.ALPHABET
        for k in range(1, U.ORDER + 1):
            ctx, ch = gram[U.ORDER - k : U.ORDER - 1], gram[-1]
            counts = {}
            for g, n in examples[c].items():
                if g[U.ORDER - k : U.ORDER - 1] == ctx:
                    counts[g[-1]] = counts.get(g[-1], 0) + n
            if counts:
                p = (counts.get(ch, 0) + len(counts) * p) / (sum(counts.values()) + len(counts))
        out.append(math.log(p))
    return out[0] - out[1]


def grams(text):
    s = "\x02" * (U.ORDER - 1) + text + "\x03"
    return [s[i : i + U.ORDER] for i in range(len(text) + 1)]


def test_against_brute_force(spark):
    r = random.Random(9)
    host = lambda: r.choice(["a", "b.c", "WWW.x", "ok", "bad"]) + r.choice([".net", ".example.net", ".example.com", ".org", ".com", "net"])
    rows = [(i, f"http{r.choice(['', 's'])}://{host()}{r.choice(['', '/', '/en/1', '/de/2', '/fr/3', '/EN/x'])}{r.choice(['', '?q=/en/', '#f'])}") for i in range(120)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "://"), (904, "x://net/"), (904, "x://net/"), (None, "ftp://é.org/fr/ü")]
    df = spark.createDataFrame([(d, u, "k") for d, u in rows], "page_id long, url string, verdict string")
    got = sorted((tuple(x) for x in U.judge(df, RULES).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    texts = {}
    for _, u in rows:
        h, p = split(u)
        texts.setdefault(h + p, [rule_of(h, p)[1], 0])[1] += 1
    held = {t for t in texts if hashlib.md5(t.encode()).hexdigest()[0] in U.HELD}
    examples = {"allow": {}, "block": {}}
    for t, (v, n) in texts.items():
        if v and t not in held:
            for g in grams(t):
                examples[v][g] = examples[v].get(g, 0) + n
    score = {t: sum(model_ratio(examples, g) for g in grams(t)) / len(grams(t)) for t, (v, _) in texts.items() if not v or t in held}
    stats = {}
    for c in ("allow", "block"):
        xs = [s for t, s in score.items() if texts[t][0] == c]
        if xs:
            m = sum(xs) / len(xs)
            stats[c] = (m, math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs)))
    edge = U.threshold_of(stats)
    want = []
    for d, u in rows:
        h, p = split(u)
        rule, verdict = rule_of(h, p)
        want.append((d, h, p, rule, verdict or ("allow" if score[h + p] >= edge else "block")))
    assert got == sorted(want, key=str)


def test_no_examples_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (2, None)], "page_id long, url string")
    assert {x.verdict for x in U.judge(df, RULES).collect()} == {"allow"}
    assert U.judge(df.limit(0), RULES).count() == 0
