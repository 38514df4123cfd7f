import hashlib
import random
import re

from braidgraph.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in text.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in spans)


def check(spark, texts):
    rows = pii.span_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        spans = base(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)], text
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest(), text
        assert set(joined(spans).split(",")) <= set(r["spans"].split(",")) or not spans
    return rows


def test_base_spans_on_random_texts(spark):
    draw = random.Random(6)
    letters = "0123456789" * 3 + "..@@++-- ()abz_%é😀\n"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(600)]
    texts += ["4111 1111 1111 1111", "x 4111-1111-1111-1111 y", "a@b.c_d@e.f", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.1.255", "+1 (517) 555-0938", "é😀 +49 30 1234567 a@b.cd", None, "", "4111 1111 1111 1112", "9" * 5000, "a" * 5000 + "@", "a@" + "b." * 3000 + "c", "1.2.3.4 " * 700]
    check(spark, texts)


def test_documents(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts)


def test_method_adds_spans(spark):
    sure = [f"please contact mail u{i}@mail.example.com or call +1 (517) 555-{1000 + i} now" for i in range(60)]
    texts = [*sure, "contact me: jane.doe (at) example.com today", "call me at 555-123-4567 please", "version 10.20.30 of the page 12-13-1415"]
    rows = check(spark, texts)
    assert "email:12:37" in rows[60]["spans"]
    assert "phone:11:23" in rows[61]["spans"]
    assert rows[62]["spans"] == ""


def test_estimates_know_good_labelers_from_bad():
    """By kind: the last labeler is a coin on one kind and the best on another."""
    draw = random.Random(1)
    counts = {}
    for kind, rights in ((0, (0.95, 0.9, 0.9, 0.9, 0.5)), (3, (0.9, 0.9, 0.9, 0.5, 0.95))):
        for _ in range(4000):
            true = draw.random() < 0.5
            votes = tuple((1 if true == (draw.random() < right) else -1) for right in rights)
            counts[kind, votes, (0, int(true), 0, 1)] = counts.get((kind, votes, (0, int(true), 0, 1)), 0) + 1
    model = pii.train([(*k, n) for k, n in sorted(counts.items())])
    right = {kind: [sum(r) / 2 for r in model.reliabilities[kind]] for kind in (0, 3)}
    assert min(right[0][:4]) > 0.85 and 0.4 < right[0][4] < 0.6
    assert right[3][4] > 0.85 and 0.4 < right[3][3] < 0.6
    assert model.weights[0][2] > model.weights[0][0]
    # What no labeler sees is in the classifier: this feature says the truth.
    assert model.feature_weights[1][0][1] > model.feature_weights[1][0][0]
    assert pii.train([]).weights


def planted(draw, i):
    """A text with one span that the base patterns don't find, or one that only looks like it; the span, or None."""
    name, host = f"{draw.choice(['jane', 'omar', 'li', 'eva'])}.{draw.choice(['doe', 'roy', 'kim'])}{i}", f"{draw.choice(['mail', 'post', 'web'])}{i}"
    card = f"{draw.randrange(4000, 5000)}{draw.randrange(10**11):011d}"
    card += str(next(x for x in range(10) if luhn(card + str(x))))
    dotted = ".".join(card[j : j + 4] for j in range(0, 16, 4))
    wrong = dotted[:-1] + str((int(dotted[-1]) + 3) % 10)
    six = ":".join(f"{draw.randrange(16**4):x}" for _ in range(6))
    local = f"({draw.randrange(201, 990)}) {draw.randrange(201, 990)}-{draw.randrange(1000, 9999)}"
    good = [("please contact ", f"{name} (at) {host}.com", " for more"), ("write a mail to ", f"{name}[at]{host}[dot]org", ", thank you"), ("my phone: ", local, " after six"), ("call ", local, "."), ("my card is ", dotted, " (visa)"), ("pay by card ", dotted, ", please"), ("our server has the addr ", f"2001:db8:{six}", ", log in there")]
    bad = [("see the date ", f"2021-{draw.randrange(10, 13)}-{draw.randrange(10, 28)} {draw.randrange(10, 24)}", "h of that year"), ("serial no ", wrong, "A in the hash"), ("lines ", f"{draw.randrange(100, 200)}-{draw.randrange(200, 300)} {draw.randrange(10, 99)}", " of the page"), ("score ", f"{draw.randrange(10, 99)}-{draw.randrange(10, 99)}-{draw.randrange(10, 99)}", "x in the vol")]
    before, span, after = draw.choice(good if i % 2 else bad)
    lead = "word " * draw.randrange(5)
    return lead + before + span + after, (len(lead + before), len(lead + before + span)) if i % 2 else None


def test_precision_and_recall_of_added_spans(spark):
    draw = random.Random(12)
    made = [planted(draw, i) for i in range(400)]
    rows = pii.span_report(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")).orderBy("doc_id").collect()
    right = wrong = 0
    for (text, span), r in zip(made, rows, strict=True):
        own = {(a, b) for a, _, b in base(text)}
        added = {(a, b) for x in r["spans"].split(",") if x for a, b in [tuple(map(int, x.split(":")[1:]))]} - own
        right += span in added
        wrong += len(added - {span})
    print("added spans: recall", right / 200, "precision", right / max(1, right + wrong))
    assert right >= 0.8 * 200 and right >= 0.9 * (right + wrong)


def test_redaction(spark):
    texts = ["mail a@b.com or +1 (517) 555-0938!", None, "", "nothing", "4111 1111 1111 1111, 10.0.0.1"]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, pii_spans string")
    rows = pii.redact(docs, length_col="n_chars").orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["mail <EMAIL> or <PHONE>!", None, "", "nothing", "<CARD>, <IP>"]
    assert rows[0]["n_chars"] == len(rows[0]["text"]) and rows[3]["n_chars"] == 7


def test_odd_rows(odd_docs, no_docs):
    assert pii.span_report(odd_docs).count() == 10
    kept = pii.redact(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("pii_spans = 'x'").count() == 10
    assert pii.span_report(no_docs).count() == 0
