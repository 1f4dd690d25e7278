"""Personal data: base spans by plain regular expressions, disclosing terms by counting in Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import regex

from mediaquarry.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, s):
    n = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else 0, "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]


def base(text):
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text) if good(kind, m[0])]


def value_of(kind, s):
    return s.lower() if kind == "email" else s if kind == "ip" else re.sub("[^0-9]", "", s)


def brute(texts):
    """For each text its base spans and the disclosing ones."""
    texts = [x or "" for x in texts]
    words = [[(m[0], m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", x)] for x in texts]
    bases, n_entity, n_term, n_both = [base(x) for x in texts], Counter(), Counter(), Counter()
    covered = lambda spans, a, b: any(s < b and a < e for _, s, e in spans)
    for text, spans, mine in zip(texts, bases, words):
        near = set()
        for kind, start, end in spans:
            left, right = max(start - pii.CONTEXT, 0), end + pii.CONTEXT
            for word, a, b in mine:
                inside = (left <= a and b <= start and (a > left or left == 0)) or (end <= a and b <= right and (b < right or b == len(text)))
                if inside and len(word.lower()) >= pii.MIN_TERM and not covered(spans, a, b):
                    near.add(((kind, value_of(kind, text[start:end])), word.lower()))
        n_entity.update({(k, value_of(k, text[s:e])) for k, s, e in spans})
        n_both.update(near)
        n_term.update({w.lower() for w, _, _ in mine if len(w.lower()) >= pii.MIN_TERM})
    kinds, general = {}, {}
    for (e, t), n in n_both.items():
        if n >= pii.SUPPORT:
            ic = math.log2(len(texts) / n_entity[e])
            pmi = math.log2(n * len(texts) / (n_term[t] * n_entity[e]))
            kinds[e, t] = "removed" if pmi >= pii.REMOVE * ic else "general" if pmi >= pii.GENERALISE * ic else None
            if kinds[e, t] is None:
                general[e] = min(general.get(e, (0, "")), (-n, t)) if e in general else (-n, t)
    verdict = {}
    for (e, t), kind in kinds.items():
        if kind == "general" and e in general:
            verdict.setdefault(t, []).append(("general", -n_both[e, t], general[e][1]))
        elif kind:
            verdict.setdefault(t, []).append(("removed", 0, None))
    out = []
    for spans, mine in zip(bases, words):
        more = []
        for word, a, b in mine:
            if (found := verdict.get(word.lower())) and not covered(spans, a, b):
                kind = max(k for k, _, _ in found)
                more.append((kind, a, b, min(x[1:] for x in found if x[0] == "general")[1] if kind == "general" else "[REMOVED]"))
        out.append((spans, sorted(more, key=lambda x: (pii.MORE_KINDS.index(x[0]), x[1]))))
    return out


def sanitised(text, spans, more):
    out, at = [], 0
    for start, end, put in sorted([(a, b, f"[{k.upper()}]") for k, a, b in spans] + [(a, b, put) for _, a, b, put in more]):
        if start >= at:
            out += [text[at:start], put]
        at = max(at, end)
    return "".join(out) + text[at:]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def expected(ids, texts):
    rows = []
    for i, (mine, more) in zip(ids, brute(texts)):
        n = Counter(k for k, _, _ in mine)
        rows.append((i, *(n[k] for k in PLAIN), hashlib.sha256(joined(mine).encode()).hexdigest(), joined([*mine, *(x[:3] for x in more)])))
    return sorted(rows, key=repr)


def found(docs):
    columns = ["doc_id", *(f"n_{k}" for k in PLAIN), "base_sha256", "spans"]
    return sorted(map(tuple, pii.find_pii(docs).select(*columns).collect()), key=repr)


def test_all_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    assert found(documents) == expected([r.doc_id for r in rows], [r.text for r in rows])


def test_strange_strings(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("a1b2.@-+ 0()%é🙂", k=rng.randint(0, 60))) for _ in range(600)]
    texts += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255", "a@b.c+d@e.f", "+1 (555) 010-9999.", "9" * 50_000, "1.2" * 9000, "a" * 50_000 + "@", "+1" + "(" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == expected(range(len(texts)), texts)


def test_disclosing_terms_are_removed_or_generalised_wherever_they_stand(spark):
    texts = ["Ask Zebulon at zeb@mill.org about the river"] * 3 + ["we met Zebulon by the river"] + ["the miller ann@mill.org and the river miller"] * 4
    texts += ["no miller here, about"] + [f"the river number {i} about Ask" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", "1 AS spans", "2 AS more")
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    want = [sanitised(t, *x) for t, x in zip(texts, brute(texts))]
    assert [out[i].text for i in range(len(texts))] == want
    assert out[3].text == "we met about by the river" and out[8].text == "no river here, about"  # rows without the datum
    assert all(r.n_chars == len(r.text) for r in out.values()) and out[20].text == texts[20] and len(out) == len(texts)
    assert pii.sanitise(docs).columns == docs.columns


def test_odd_rows(odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    assert found(odd_documents) == expected([r.doc_id for r in rows], [r.text for r in rows])
    assert found(no_documents) == [] and pii.sanitise(no_documents).count() == 0
    assert pii.sanitise(odd_documents).count() == odd_documents.count()


def test_a_text_of_many_data_takes_time_in_proportion(spark):
    text = " ".join(f"write to bob{i}@x.org now" for i in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    (row,) = pii.find_pii(docs).select("n_email", "spans").collect()
    assert row.n_email == 40_000 and time.perf_counter() - began < 60
    last = text.rindex("bob")
    assert row.spans.split(",")[39_999] == f"email:{last}:{text.rindex(' ')}"
