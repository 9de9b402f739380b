"""The operators that use DataFrame functions only: pseudonyms, decontamination, line dedup."""

import datetime
import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from weftlink.llm import decontam, linededup, pii


def test_line_dedup_as_brute_force(spark, docs, prose):
    common = [prose(50 + i, 6) for i in range(5)]
    texts = ["\n".join([prose(i, 5), *common[: i % 6], prose(i + 9, 5), *common[i % 3 :]]) for i in range(30)]
    texts += ["\n\n\n\n", "a\nb", "", None, "r\n" * 40, texts[0], "\n".join(prose(i, 3) for i in range(3000))]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(w):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        expected[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    frame = docs(texts).withColumnRenamed("source", "pos").repartition(3)
    rows = linededup.remove_repeats(frame)
    assert rows.columns == ["doc_id", "text", "lang", "pos", "n_chars", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows.collect()} == expected


def test_line_dedup_of_repeated_rows_and_nothing(spark, docs):
    one = docs(["a\nb\nc\nd"])
    assert [r.n_removed for r in linededup.remove_repeats(one.union(one)).collect()] == [0, 0]
    assert linededup.remove_repeats(docs([])).collect() == []


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_decontamination_as_brute_force(spark, docs, prose):
    items = [prose(1000 + i, 5 + 3 * i) for i in range(14)] + ["two words", None, "", "..."]
    texts = [prose(i, 200) for i in range(20)]
    for i, item in enumerate(items[:14]):
        w = item.split()
        texts.append(prose(30 + i, 3000) + " " + item.upper().replace(" ", ", ") + " " + prose(60 + i, 10))
        w[len(w) // 2] = "changed"
        texts.append(prose(90 + i, 40) + "\n" + " ".join(w))
        texts.append(" ".join(item.split()[: len(w) // 2]))
    texts += [None, "", "Two  WORDS!", items[3]] + [prose(5, 30) + " " + items[9]] * 40
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {}
    for d, t in enumerate(texts):
        for b, item in enumerate(items):
            s = shingles(item or "")
            if s and len(s & shingles(t or "")) / len(s) >= 0.8:
                expected[d, b] = (len(s), len(s & shingles(t)))
    for limit in (500_000, 0):
        rows = decontam.contained_items(docs(texts).withColumnRenamed("source", "shingles"), bench.withColumn("draws", F.lit(1)), broadcast_numbers=limit).collect()
        assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in rows} == expected and len(rows) == len(expected)
    assert decontam.contained_items(docs([]), bench).collect() == []
    assert decontam.contained_items(docs(texts[:3]), bench.limit(0)).collect() == []


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms_keep_their_format(spark, docs):
    values = ["4111111111111111", "4111 1111 1111 1111", "378282246310005", "+1 (017) 555-7713", "(212) 555-0187", "97.51.17.173", "078-05-1120", "1999-12-31", "29/02/2000", "01.05.1980", "Ab.34@mail7.example.com", "x9@a.org", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]
    clean = ["4111111111111112", "300.1.2.3", "1.2.3", "30/02/2000", "1850-01-01", "000-12-3456", "CC BY-NC 4.0", "version 3.", "DE88370400440532013000", "x @ y", "12345"]
    texts = [f"né {v}, und {w}." for v in values for w in values] + [f"so {c} ok" for c in clean] + [None, "", "é" * 10000]
    frame = docs(texts).withColumn("n_card", F.lit("old")).withColumn("_m2", F.lit(1))
    rows = sorted(pii.pseudonymize(frame).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows[len(values) ** 2 :]] == texts[len(values) ** 2 :]
    new = {}
    for i, r in enumerate(rows[: len(values) ** 2]):
        v, w = values[i // len(values)], values[i % len(values)]
        assert r.n_values == 2, (v, w)
        m = re.fullmatch(r"né (.*), und (.*)\.", r.text)
        for old, now in ((v, m[1]), (w, m[2])):
            assert new.setdefault(old, now) == now  # equal values stay linked
            assert old != now and re.sub("[0-9]", "9", old) == re.sub("[0-9]", "9", now) or "@" in old or len(old) == 40 or old.count(".") == 3
    assert len(set(new.values())) == len(values)
    for old, now in new.items():
        assert len(old) == len(now) or old.count(".") == 3
        if len(re.sub("[^0-9]", "", old)) > 14 and old[0] in "34":
            assert luhn(now)
    assert re.fullmatch(r"[A-Z][a-z]\.\d\d@mail7\.example\.com", new["Ab.34@mail7.example.com"])
    assert re.fullmatch("[0-9a-f]{40}", new["04dbebab91ab85687d33eeaaf9ac699e1188f962"]) and re.fullmatch("[0-9A-F]{40}", new["9233A8ECF7C5B09FE5949719B6B82BC439E9329B"])
    assert new["4111 1111 1111 1111"].replace(" ", "") == new["4111111111111111"]
    iban = new["GB82WEST12345698765432"]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert all(int(o) < 256 for o in new["97.51.17.173"].split("."))


def test_neighbours_are_told_apart(spark, docs):
    texts = ["+1 (826) 555-4081 190.137.223.204", "+49 30 1234 5678 190.137.223.204 x", "4111111111111111 4111111111111111", "a.1@b.org,c.2@b.org"]
    rows = sorted(pii.pseudonymize(docs(texts)).collect(), key=lambda r: r.doc_id)
    assert [r.n_values for r in rows] == [2, 2, 2, 2]
    for t, r in zip(texts, rows):
        assert not set(re.split("[ ,]", t)[-1:]) & set(re.split("[ ,]", r.text)) or t.endswith("x")


def test_permutation(spark):
    for a, b in ((10, 10), (10, 1), (7, 4), (26, 26)):
        rows = spark.range(a * b).select("id", pii.permute(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), "k", F.lit("t")).alias("to")).collect()
        assert sorted(r.to for r in rows) == list(range(a * b))
        assert all(r.to != r.id for r in rows)


def test_pseudonyms_of_nothing(spark, docs):
    assert pii.pseudonymize(docs([])).collect() == []
    counts = Counter(r.n_values for r in pii.pseudonymize(docs(["a 1.2.3.4", "a 1.2.3.4"])).collect())
    assert counts == {1: 2}


def plain_permute(x, a, b, key, tweak):
    number = lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:15], 16)

    def network(x, rounds, sign):
        left, right = divmod(x, b)
        for i in rounds:
            f = number("|".join((key, tweak, str(i), str(left if i % 2 else right))))
            left, right = (left, (right + sign * f) % b) if i % 2 else ((left + sign * f) % a, right)
        return left * b + right

    n = a * b
    shifted = (network(x, range(8), 1) + 1 + number("|".join((key, tweak, "shift"))) % (n - 1)) % n
    return network(shifted, reversed(range(8)), -1)


def plain_string(s, base, key, tweak):
    half = len(s) // 2
    x = plain_permute(int(s, base), base ** (len(s) - half), base**half, key, tweak)
    out = ""
    for _ in s:
        x, r = divmod(x, base)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out


def plain_filled(form, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def plain_pieces(pattern, s, change):
    out, at = [], 0
    for m in re.finditer(pattern, s):
        out.append(change(m[0], s[: m.start()]))
    return "".join(out)


def plain_pseudonym(kind, m, key):
    digits = re.sub("[^0-9]", "", m)
    if kind in ("phone", "social"):
        return plain_filled(m, plain_string(digits, 10, key, kind))
    if kind == "card":
        body = plain_string(digits[:-1], 10, key, "card")
        return plain_filled(m, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "secret":
        new = plain_pieces(".{1,12}", m.lower(), lambda p, before: plain_string(p, 16, key, "secret" + before))
        return new if m == m.lower() else new.upper()
    if kind == "ip":
        n = plain_permute(int.from_bytes(map(int, m.split(".")), "big"), 1 << 16, 1 << 16, key, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "date":
        form = "%Y-%m-%d" if "-" in m else "%d/%m/%Y" if "/" in m else "%d.%m.%Y"
        first = datetime.datetime(1900, 1, 1)
        day = plain_permute((datetime.datetime.strptime(m, form) - first).days, 250, 292, key, "date")
        return (first + datetime.timedelta(day)).strftime(form)
    if kind == "iban":
        plain = m.replace(" ", "")
        account = plain[4:]
        numbers = re.sub("[^0-9]", "", account)
        account = plain_filled(account, plain_pieces(".{1,15}", numbers, lambda p, before: plain_string(p, 10, key, "iban" + plain[:2] + before)))
        check = 98 - int("".join(str(int(c, 36)) for c in account + plain[:2] + "00")) % 97
        rest = iter(f"{plain[:2]}{check:02d}{account}")
        return "".join(c if c == " " else next(rest) for c in m)
    local, domain = m.split("@")

    def change(p, before):
        tweak = "email" + before.lower() + "@" + domain.lower()
        if p[0].isdigit():
            return plain_string(p, 10, key, tweak)
        low = "".join("0123456789abcdefghijklmnop"["abcdefghijklmnopqrstuvwxyz".index(c)] for c in p.lower()) if re.match("[a-zA-Z]", p) else None
        if low is None:
            return p
        new = "".join("abcdefghijklmnopqrstuvwxyz"[int(c, 26)] for c in plain_string(low, 26, key, tweak))
        return new if p[0].islower() else new.upper()

    return plain_pieces("[0-9]{1,17}|[a-z]{1,12}|[A-Z]{1,12}|[^0-9a-zA-Z]+", local, change) + "@" + domain


def test_pseudonyms_as_brute_force(spark, docs):
    rng = random.Random(3)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    digits, values = "0123456789", []
    for _ in range(12):
        body = pick(digits[1:], 15)
        values.append(("card", body + next(c for c in digits if luhn(body + c))))
        values.append(("secret", pick("0123456789abcdef", rng.randint(32, 64))))
        values.append(("secret", pick("0123456789ABCDEF", 40)))
        account = pick(digits, rng.randint(11, 26))
        values.append(("iban", f"DE{98 - int(account + '131400') % 97:02d}{account}"))
        values.append(("phone", f"({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}"))
        values.append(("phone", f"+49 30 {pick(digits, 4)} {pick(digits, 4)}"))
        values.append(("ip", ".".join(str(rng.randrange(256)) for _ in range(4))))
        values.append(("social", f"1{pick(digits, 2)}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"))
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73000))
        values += [("date", day.strftime(f)) for f in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y")]
        values.append(("email", f"{pick('abcXYZ019._-', rng.randint(1, 50))}q@{pick('abc', 5)}.Mail-{pick(digits, 2)}.org"))
    rows = sorted(pii.pseudonymize(docs([f"; {m}; " for _, m in values]), "k2").collect(), key=lambda r: r.doc_id)
    assert [(r.text, r.n_values) for r in rows] == [(f"; {plain_pseudonym(kind, m, 'k2')}; ", 1) for kind, m in values]


def test_hostile_texts(spark, docs):
    size = 1 << 20
    texts = ["x@" + "a." * 2000 + "1", "x@" + "a." * (size // 2) + "1", "a." * (size // 2), "a-" * (size // 2), "1" * size, " " * size, "x" * size + "@a.org", "1 " * (size // 2), "+1 " * (size // 3), "(1" * (size // 2), "1." * (size // 2), "x@" * (size // 2), "AB12 CDEF " * (size // 10)]
    rows = sorted(pii.pseudonymize(docs(texts)).select("doc_id", "text", "n_values").collect())
    assert [r.text for r in rows] == texts and not any(r.n_values for r in rows)
