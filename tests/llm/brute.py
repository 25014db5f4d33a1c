"""Plain Python versions of the operators, as slow as they are simple."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(text):
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = words(lower_ascii(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_dup(docs):
    """doc_id -> (n_shingles, component_id), for (doc_id, text) pairs with distinct ids; and the links between different sets."""
    sets, by_set = {}, defaultdict(list)
    for i, text in docs:
        sets[i] = shingles(text)
        by_set[sets[i]].append(i)
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(a, b):
        a, b = sorted((find(a), find(b)))
        root[b] = a

    index, links = defaultdict(list), 0
    for s, ids in by_set.items():
        if not s:
            continue
        for i in ids[1:]:
            link(ids[0], i)
        shared = Counter(j for x in s for j in index[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                link(j, ids[0])
                links += 1
        for x in s:
            index[x].append(ids[0])
    return {i: (len(sets[i]), find(i)) for i, _ in docs}, links


def host_base(text):
    w = words(text)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def substring_dedup(docs, window=50):
    """doc row -> (n_words, n_removed, kept_sha256) for (doc_id, text) pairs."""
    first = {}
    for i, text in docs:
        w = words(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    out = []
    for i, text in docs:
        w = words(text)
        gone = set()
        for p in range(len(w) - window + 1):
            m = first.get(tuple(w[p : p + window]))
            if m is not None and (i is None or m < i):
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_failed(text):
    n, _, _, _, repeats = host_base(text)
    return n < 10 or 100 * repeats > 20 * n


def jump(key, shards):
    """Jump consistent hashing as published."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def mix(docs, budget=1.5, epochs=2.0, weights=(5, 2, 1), seed=1):
    """doc_id -> copies, for (doc_id, source, text): clamps and reshares until nobody is above."""
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, target = budget * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if epochs * sizes[s] <= level * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = {}
    for s in order:
        ratio = target[s] / sizes[s] if sizes[s] else 0
        whole = int(ratio)
        quota, so_far = target[s] - whole * sizes[s], 0
        mine = sorted((int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16), i, len(words(t))) for i, x, t in docs if x == s)
        for _, i, n in mine:
            so_far += n
            out[i] = whole + (so_far - n / 2 <= quota and quota > 0)
    return out


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower_ascii(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return None, None
    longest = max(f[0] for f in fits)
    return min(f[1:] for f in fits if f[0] == longest)


def url_model(urls, order=4, keep=0.95):
    """url -> (score, threshold) of the URLs without a ruling, for (url, ruling)."""
    urls = sorted(set(urls), key=str)
    held = lambda u: zlib.crc32(u[0].encode()) % 5 == 0

    def runs(u):
        s = "\x02" * order + u[0] + "\x03"
        return [s[i : i + order + 1] for i in range(len(s) - order)]

    counts = {k: [Counter() for _ in range(order + 1)] for k in ("allow", "block")}
    for u in urls:
        if u[1] and not held(u):
            for r in runs(u):
                for k in range(order + 1):
                    counts[u[1]][k][r[order - k :]] += 1
    contexts = {}
    for kind, tables in counts.items():
        for k, t in enumerate(tables):
            for g, n in t.items():
                c = contexts.setdefault((kind, k, g[:-1]), [0, 0])
                c[0] += n
                c[1] += 1

    def p(kind, run):
        out = 1 / 256
        for k in range(order + 1):
            g = run[order - k :]
            n, t = contexts.get((kind, k, g[:-1]), (0, 0))
            if n + t:
                out = (counts[kind][k][g] + t * out) / (n + t)
        return out

    scores = {}
    for u in urls:
        if not u[1] or held(u):
            r = runs(u)
            scores[u] = round(sum(math.log(p("allow", x)) - math.log(p("block", x)) for x in r) / len(r), 6)

    def quantile(kind, q):
        v = sorted(s for u, s in scores.items() if u[1] == kind)
        return v[max(0, math.ceil(q * len(v)) - 1)]

    threshold = (quantile("allow", 1 - keep) + quantile("block", keep)) / 2
    return {u[0]: (s, threshold) for u, s in scores.items() if not u[1]}


UNITS = "mm|cm|dm|m|km|in|ft|yd|mi|mg|g|kg|t|oz|lb|ml|cl|l|s|ms|sec|min|h|hr|hrs|hours|minutes|seconds|days|weeks|months|years|kmh|mph|percent|dollars|euros|cents|usd|eur|gbp|meters|metres|miles|grams|liters|litres|degrees"


def template(text):
    """(kind of token, token) in order; the kind of a plain word is the word."""
    text = regex.sub(r"[^\S\n]+", " ", (text or "").translate({0xA0: " ", 0x2007: " ", 0x202F: " "}))
    out = []
    for m in regex.finditer(r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*", text):
        word, at = m[0], m.start()
        if word[0] in "0123456789":
            out.append(("<number>", word))
        else:
            # a word may begin right after a unit: "5 kmh" is one word, "5km" a number and a unit
            name = regex.match(r"\p{Lu}\p{Ll}", word) and regex.search(r"[\p{L}\p{N},;] $", text[:at])
            unit = regex.search(r"[0-9] ?$", text[:at]) and regex.fullmatch(f"(?i:{UNITS})", word) and not regex.match(r"\p{N}", text[m.end() :])
            out.append(("<name>" if name else "<unit>" if unit else word.lower(), word.lower()))
    return out


def contaminated(docs, items, window=8, coverage=0.5):
    """For (doc_id, text) and (item_id, text): the sorted (item_id, coverage) found in each text, in the order of the texts."""
    out = []
    items = [(i, template(t)) for i, t in items if template(t)]
    plain = lambda t: t[0] if t[0] == "<number>" else t[1]
    slot = lambda t: t[0] in ("<number>", "<name>", "<unit>")
    for _, text in docs:
        doc, found = template(text), []
        places = defaultdict(list)
        for n in {min(window, len(t)) for _, t in items}:
            for p in range(len(doc) - n + 1 if n == window or n == len(doc) else 0):
                w = doc[p : p + n]
                typed, words = tuple(t[0] for t in w), tuple(map(plain, w))
                for key in {("typed", typed), ("typed", words), ("exact", tuple(t[1] for t in w))}:
                    places[key].append(p)
        for i, item in items:
            n = min(window, len(item))
            hits, values = defaultdict(set), defaultdict(lambda: defaultdict(set))
            for q in range(len(item) - n + 1):
                w = item[q : q + n]
                typed, words = tuple(t[0] for t in w), tuple(map(plain, w))
                bare = all(map(slot, w))
                keys = {("typed", words)} - {("typed", typed)} if bare else {("typed", typed), ("typed", words)}
                for key in keys:
                    for p in places[key]:
                        hits[p - q].add(q)
                        for k, t in enumerate(w):
                            if slot(t):
                                values[p - q][t[1] if t[0] == "<number>" else t].add(doc[p + k][1])
                if bare:
                    for p in places["exact", tuple(t[1] for t in w)]:
                        hits[p - q].add(q)
            sound = set().union(*(h for d, h in hits.items() if all(len(v) == 1 for v in values[d].values())))
            if sound and len(sound) >= coverage * (len(item) - n + 1):
                found.append((i, len(sound) / (len(item) - n + 1)))
        out.append(sorted(found))
    return out


def luhn(digits):
    """Whether the last digit checks the others."""
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def surrogates(texts, key):
    """The texts with surrogates for their entities, and the number of entities in each; draws again until no two meet."""
    from inkfold.llm.pii_surrogates import _GAP, _PART, _TITLES, ALPHABETS, ENDINGS, PATTERNS, SYLLABLES, TITLES, WIDER  # fixed values

    found = "|".join(PATTERNS.values())
    head_of = lambda e: (regex.match(_TITLES, e) or [""])[0]
    bare = lambda x: "".join(c for c in x.lower() if regex.match(r"[\p{L}\p{N}]", c))
    canon = lambda kind, x: x if kind == "ip" else bare(x)
    digest = lambda f, *parts: f("\x00".join(parts).encode()).hexdigest()

    def kind_of(e):
        return next((k for k in ("email", "ip", "ipv6", "phone", "ssn", "card", "secret") if regex.fullmatch(PATTERNS[k], e)), "name")

    def entities(text):
        """The matches with what says what they are: for a name without a title the first one with one."""
        first = list(regex.finditer(found, text or ""))
        full = {m[0][len(head_of(m[0])) :] for m in first if head_of(m[0])}
        full = sorted((n for n in full if regex.match(_PART + _GAP + _PART, n)), key=lambda n: (-len(n), [-ord(c) for c in n]))
        if not full:
            return [(m, m[0]) for m in first]
        again = rf"{found}|(?<![\p{{L}}\p{{M}}])(?:{'|'.join(map(regex.escape, full))})(?![\p{{L}}\p{{M}}])"
        every = list(regex.finditer(again, text))
        titled = {}
        for m in every:
            if head_of(m[0]):
                titled.setdefault(m[0][len(head_of(m[0])) :], m[0])
        return [(m, m[0] if head_of(m[0]) else titled.get(m[0], m[0])) for m in every]

    def pieces(e):
        kind = kind_of(e)
        if kind != "name":
            return [(kind, e)]
        said = [g for t in regex.findall(r"[\p{L}\p{M}]+", head_of(e)) for g in "fm" if t in TITLES[g]]
        words = regex.findall(_PART, e[len(head_of(e)) :])
        return [("initial" if len(w) == 1 else "first " + (said or ["n"])[0] if i < len(words) - 1 else "family", w) for i, w in enumerate(words)]

    def walk(units, tweak, shift):
        cut = max(len(units) // 2, 1)
        sides = {"l": units[:cut], "r": units[cut:]}
        for turn in range(1, 5):
            for side, other in (("l", "r"), ("r", "l")):
                h = hashlib.sha512(":".join([key, str(tweak), str(turn), side, ".".join(sides[other])]).encode()).hexdigest()
                sides[side] = [shift(c, int(h[k % 32 * 4 :][:4], 16)) for k, c in enumerate(sides[side])]
        return sides["l"] + sides["r"]

    def letter(kind):
        def shift(c, by):
            for a in ["0123456789abcdef"] if kind in ("secret", "ipv6") else ALPHABETS:
                if c in a:
                    return a[(a.index(c) + by) % len(a)]
            return c

        return shift

    def octet(tweak):
        def shift(c, by):
            low, high = (0, 256) if tweak >= WIDER else (100, 256) if int(c) >= 100 else (10, 100) if int(c) >= 10 else (0, 10)
            return str((int(c) - low + by) % (high - low) + low)

        return shift

    def made(kind, e, tweak):
        if kind == "ip":
            return ".".join(walk(e.split("."), tweak, octet(tweak)))
        if kind.startswith("first ") or kind == "family":
            script = "cyrillic" if regex.search(r"\p{IsCyrillic}", e) else "greek" if regex.search(r"\p{IsGreek}", e) else "latin"
            h = digest(hashlib.md5, key, str(tweak), kind, e.lower())
            out = "".join(SYLLABLES[script][int(d, 16)] for d in h[: 8 if kind == "family" else 7]) + (ENDINGS[script][kind[-1]] if kind != "family" else "")
            return out.upper() if e == e.upper() else out[0].upper() + out[1:]
        head = regex.match(r"\+[0-9]{1,3}(?=[ .\-(])", e) if kind == "phone" else None
        tail = regex.search(r"\.[A-Za-z]+$", e) if kind == "email" else None
        head, tail = head[0] if head else "", tail[0] if tail else ""
        core = e[len(head) : len(e) - len(tail)]
        units = list(bare(core))
        if kind == "card" and luhn(units):
            units = walk(units[:-1], tweak, letter(kind))
            units.append(next(d for d in "0123456789" if luhn([*units, d])))
        else:
            units = walk(units, tweak, letter(kind))
        new = iter(units)
        core = "".join(c if not bare(c) else (n.upper() if c != c.lower() else n) for c in core for n in [next(new) if bare(c) else ""])
        longer = "".join(SYLLABLES["latin"][int(d, 16)] for d in digest(hashlib.md5, key, str(tweak), e.lower())[:8]) if kind == "email" and tweak >= WIDER else ""
        return head + longer + core + tail

    known = {}
    for t in texts:
        for _, said in entities(t):
            for kind, e in pieces(said):
                if kind != "initial":
                    at = kind, canon(kind, e)
                    known[at] = min(known.get(at, e), e)
    tweaks = dict.fromkeys(known, 0)
    while True:
        drawn = {(k, c): (k, canon(k, made(k, known[k, c], n))) for (k, c), n in tweaks.items()}
        first = {}
        for at in sorted(drawn):
            first.setdefault(drawn[at], at)
        bad = [at for at, s in drawn.items() if first[s] != at or s in known]
        if not bad:
            break
        for at in bad:
            tweaks[at] += 1

    def replaced(e, said):
        new = [made(k, x, tweaks.get((k, canon(k, x)), 0)) for k, x in pieces(said)]
        if kind_of(e) != "name":
            return new[0]
        rest = iter(new)
        return head_of(e) + regex.sub(_PART, lambda _: next(rest), e[len(head_of(e)) :])

    out = []
    for t in texts:
        every, at, new = entities(t), 0, ""
        for m, said in every:
            new += t[at : m.start()] + replaced(m[0], said)
            at = m.end()
        out.append((None if t is None else new + t[at:], len(every)))
    return out


def kneser_ney(trained, asked, order=4):
    """The perplexity of each asked text (None for an empty one), by UTF-16 unit, under a model of the trained ones."""

    def units(text):
        raw = text.encode("utf-16-le")
        return [int.from_bytes(raw[i : i + 2], "little") or 0xFFFF for i in range(0, len(raw), 2)]

    def grams(text):
        u = [0] * (order - 1) + units(text)
        return [tuple(u[i : i + order]) for i in range(len(u) - order + 1)] if text else []

    tables = {order: Counter(g for t in trained for g in grams(t or ""))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discounts, totals, spares = {}, {}, {}
    for k, t in tables.items():
        n = [sum(c == i for c in t.values()) for i in (1, 2, 3, 4)]
        if n[0] and n[1]:
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
        else:
            d = [0.5, 0.75, 0.9]
        discounts[k] = lambda c, d=d: d[min(c, 3) - 1]
        totals[k], spares[k] = Counter(), Counter()
        for g, c in t.items():
            totals[k][g[:-1]] += c
            spares[k][g[:-1]] += discounts[k](c)

    def p(g, k):
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        g = g[order - k :] if len(g) == order else g
        low = p(g[1:], k - 1)
        total = totals[k].get(g[:-1])
        if not total:
            return low
        c = tables[k].get(g, 0)
        return ((max(c - discounts[k](c), 0) if c else 0) + spares[k][g[:-1]] * low) / total

    return [math.exp(-sum(math.log(p(g, order)) for g in grams(t)) / len(grams(t))) if t else None for t in asked]


def swapped(text, identity, versions):
    """The text with its identity terms swapped for others of their kinds, ``versions`` times, and once without them; nothing if it has none."""
    known = {t: (v, i) for v in identity.values() for i, t in enumerate(v)}
    cut = regex.split(r"([A-Za-z\x80-\U0010ffff]+)", text)
    if not any(w.lower() in known for w in cut):
        return []
    out = []
    for turn in range(versions):
        new = list(cut)
        for j, w in enumerate(cut):
            if w.lower() in known:
                v, i = known[w.lower()]
                new[j] = v[(i + 1 + turn * max(1, (len(v) - 1) // versions) % (len(v) - 1)) % len(v)]
        out.append("".join(new))
    return [*out, "".join(w for w in cut if w.lower() not in known)]


def thresholds(rows, held, q, prior):
    """(doc_id, lang, perplexity) -> the threshold of each language: its mean logarithm, and a spread drawn to that of all."""
    level = lambda v: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
    known = [(lang, p) for i, lang, p in rows if i in held and p is not None]
    overall = level([p for _, p in known])
    logs = defaultdict(list)
    for lang, p in known:
        if lang is not None:
            logs[lang].append(math.log(p))
    means = {lang: sum(v) / len(v) for lang, v in logs.items()}
    pooled = level([x - means[lang] for lang, v in logs.items() for x in v])
    out = {lang: overall for _, lang, _ in rows}
    for lang, v in logs.items():
        own = level([x - means[lang] for x in v])
        out[lang] = math.exp(means[lang] + (len(v) * own + prior * pooled) / (len(v) + prior))
    return out
