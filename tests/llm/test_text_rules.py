import re
import string
import textwrap

from pyspark.sql import functions as F

from draftlake.llm import chat, licences, quality_rules
from tests.llm import frames

A_Z = string.ascii_uppercase
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark):
    rep = " ".join(["one two three four five six seven eight nine"] * 3)
    texts = [(i, t) for i, t in enumerate([rep, rep + " x " + rep, "a " * 40, "#a $b\n#a $b\n\n c|d", "ü ß\v日本\f x\x1cy", frames.prose(1, 300)])]
    got = quality_rules.line_frequency(frames.awkward(spark).unionByName(frames.frame(spark, [(i + 100, t) for i, t in texts])))
    for r in got.collect():
        c = r.rules
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == brute_counts(r.text or ""), r.doc_id
        assert c.base_failed == (c.n_words < 20 or 100 * c.n_repeat_words > 30 * c.n_words)
        assert r.h == "x" and r.kept == "no"
    assert got.count() == 18
    assert quality_rules.line_frequency(frames.empty(spark)).count() == 0


def test_frequent_lines_leave_and_depleted_documents_fail(spark):
    foot = "Read our terms of use and the notes on privacy before you go on"
    texts = [(3 * i, frames.prose(i, 60) + "\n" + foot.upper()) for i in range(20)] + [(3 * i, foot + "\n" + foot + " \nshort") for i in range(20, 22)]
    copies = [(300 + 3 * i, frames.CLEAN) for i in range(30)]  # copies of one text are one document
    got = {r.doc_id: r for r in quality_rules.line_frequency(frames.frame(spark, texts + copies), min_left=0.3).collect()}
    assert got[0].rules.n_removed_lines == 1 and foot.upper() not in got[0].clean_text and got[0].rules.kept
    assert got[60].rules.n_removed_lines == 2 and got[60].rules.depleted and not got[60].rules.kept
    assert got[300].rules.n_removed_lines == 0 and got[300].clean_text == frames.CLEAN and got[300].rules.kept


def test_absolute_limit_holds_on_large_hosts(spark, monkeypatch):
    foot, rare = "All prices are given without tax", "Open on Mondays from nine to five"
    texts = [(3 * i, f"{frames.prose(i, 30)}\n{foot if i < 7 else frames.prose(90 + i, 5)}\n{rare if i < 6 else ''}") for i in range(80)]
    judge = lambda: {
        r.doc_id: (r.rules.n_removed_lines, r.clean_text)
        for r in quality_rules.line_frequency(frames.frame(spark, texts), max_docs=6).collect()
    }
    got = judge()
    assert [i for i in got if got[i][0]] == [3 * i for i in range(7)] and all(n <= 1 for n, _ in got.values())
    assert foot not in got[0][1] and rare in got[0][1]  # seven documents of eighty are no tenth; six are not over the limit
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)  # the salted join gives the same
    assert judge() == got


def test_licences_against_brute_force(spark):
    texts = [
        (20, "Released under the MIT License. cc by cc-by CC BY"), (21, "the GNU General\nPublic License"), (22, "gnu general public licenses"),
        (23, "permission is hereby granted free of charge to any person obtaining a copy of this software\nand"), (24, "MIT license MIT license apache-license"),
        (25, frames.prose(3, 250) + " " + licences.TEMPLATES[2][1]), (26, "\u212a wor\u212a CC BY \u0130"),
        (27, (frames.prose(5, 700) + "\n\n" + licences.TEMPLATES[11][1] + " ") * 3), (28, "mit " * 600 + licences.TEMPLATES[4][1]),
    ]
    df = frames.awkward(spark).unionByName(frames.frame(spark, texts))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = licences.scan(df)
    for r in got.collect():
        w = word.findall((r.text or "").translate(str.maketrans(A_Z, A_Z.lower())))
        places = sorted((i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        labels, score = {x for _, x in places}, 1.0 if places else 0.0
        for label, t in licences.TEMPLATES:
            words = licences.template_words(t)
            n = -(-5 * len(t.replace("-", " ").split()) // 4)  # over 0.8, rounded up
            for i in range(len(w)) if words & set(w) else ():
                have = set(w[i:i + n])
                if len(words & have) >= licences.THRESHOLD * len(words) - 1e-9:
                    labels.add(label)
                    score = max(score, len(words & have) / len(words))
        c = r.licence
        assert (c.n_words, c.n_base) == (len(w), len(places)), r.doc_id
        assert (c.first_word, c.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert c.base_labels == ",".join(sorted({x for _, x in places})) and c.labels == ",".join(sorted(labels)) and c.score == score
    assert got.count() == 21 and licences.scan(frames.empty(spark)).count() == 0


def test_wrapped_notices_are_met_and_strewn_words_are_not(spark):
    notices = {"mit": licences.TEMPLATES[4][1], "apache": licences.TEMPLATES[2][1], "bsd": licences.TEMPLATES[11][1]}
    wrapped = {k: "\n".join(f"// {x}" for x in textwrap.wrap(t, 66, initial_indent=" " * 30)) for k, t in notices.items()}
    around = lambda i, t: f"{frames.prose(i, 240)}\n{t}\n{frames.prose(i + 1, 40)}"
    texts = [(i, around(i, t)) for i, t in enumerate(wrapped.values())]
    strewn = [(10 + i, " ".join(f"{w} {frames.prose(j, 9)}" for j, w in enumerate(t.split()))) for i, t in enumerate(notices.values())]
    got = {r.doc_id: r.licence for r in licences.scan(frames.frame(spark, texts + strewn)).collect()}
    assert all("\n" in t for t in wrapped.values())
    assert [got[i].labels for i in range(3)] == list(notices) and all(got[i].score == 1 for i in range(3))
    assert all(got[10 + i].labels == "" and got[10 + i].score == 0 for i in range(3))


def test_layouts_become_turns(spark):
    records = [
        '{"role": "user", "text": "hi"}', '{"role": null, "text": null}', '{"prompt": "p", "response": "r"}',
        '{"instruction": "i", "input": "x", "output": "o"}', '{"messages": [{"role": "system", "content": "s"}, {"role": "gpt", "content": "{}"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"strange": {"deep": [1]}}', '[]',
    ]
    df = spark.createDataFrame([(r,) for r in records], "j string").select(chat.canonical_turns(F.parse_json("j")).alias("c"))
    got = [(r.c.mapping, [tuple(t) for t in r.c.turns]) if r.c else None for r in df.collect()]
    assert got == [
        ("turn", [("user", "hi")]), ("turn", [("", "")]), ("prompt", [("user", "p"), ("assistant", "r")]),
        ("instruction_input", [("user", "i"), ("user", "x"), ("assistant", "o")]), ("messages", [("system", "s"), ("assistant", "{}")]),
        ("from_value", [("user", "q"), ("assistant", "a")]), None, None,
    ]


def test_format_round_trip(spark):
    said = ["<|im_end|>", "<\\|x", "\\<|", "\\\\", "", None, "a\nb<", "|", "<|im_start|>assistant\nü日"]
    rows = [(c, i, r, t, "x") for c in (1, None) for i, (r, t) in enumerate(zip(["user", "assistant", "a\\n\n<|b", None, "assistant"] * 2, said))]
    df = spark.createDataFrame(rows, "conv long, turn int, role string, text string, turns string")
    out = chat.format_rows(df, "conv", "turn", F.to_variant_object(F.struct("role", "text")))
    out = out.select("conv", "turns", chat.parsed(F.col("text")).alias("back"), chat.masked_text(F.col("text"), F.col("loss_spans")).alias("loss"), "unknown")
    for r in out.collect():
        assert [tuple(t) for t in r.back] == [(a or "", t or "") for c, _, a, t, _ in rows if c == r.conv]
        assert r.loss == "".join(t or "" for c, _, a, t, _ in rows if c == r.conv and a == "assistant") and r.unknown == 0
    assert chat.format_rows(df.where("false"), "conv", "turn", F.to_variant_object(F.struct("role", "text"))).count() == 0
