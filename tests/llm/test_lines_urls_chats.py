import datetime as dt

from hypothesis import given
from hypothesis import strategies as st

from panelforge.llm import chat_format, line_dedup, url_filters
from panelforge.llm.common import connected_components


def test_line_dedup(docs, prose):
    a, b = prose(1, 40), prose(2, 40)
    close = a.replace(a.split()[20], "changed")
    short = "Copyright notice of 2024."
    rows = [(1, f"{a}\n\n{short}\n{b}"), (2, f"{close}\nown line here is new\n{short}"), (3, b + "\n" + b), (4, None), (5, ""), (6, f"{short}\n{short}"), (None, prose(3, 30)), (2, f"{close}\nown line here is new\n{short}"), (7, "  \n\t\n")]
    out = line_dedup.deduplicate(docs(rows))
    assert out.columns == docs([]).columns
    got = sorted((r.doc_id or -1, r.text) for r in out.collect() if r.doc_id != 4)
    want = [(1, rows[0][1]), (2, "own line here is new"), (2, "own line here is new"), (3, ""), (5, ""), (6, ""), (-1, prose(3, 30)), (7, "  \n\t\n")]
    assert got == sorted(want)
    assert [r.text for r in out.where("doc_id = 4").collect()] == [None]
    assert line_dedup.deduplicate(docs([])).count() == 0


def test_line_keys_have_one_family(docs):
    """Lines that link share keys however many words they have: lists with ',' and ', ', blanks in long words, short lines."""
    import random

    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    items, long, short = [word(60) for _ in range(30)], [word(290) for _ in range(7)], word(13)
    blanks = " ".join(w[:145] + " " + w[145:] for w in long)
    pairs = [(",".join(items), ", ".join(items)), (" ".join(long), blanks), (short, short[:-1]), (short[:9], short[:8]), ("-" * 7, "-" * 40)]
    out = line_dedup.deduplicate(docs([(2 * i + k, line) for i, p in enumerate(pairs) for k, line in enumerate(p)]))
    assert {r.doc_id: r.text for r in out.collect()} == {2 * i + k: "" if k else p[0] for i, p in enumerate(pairs) for k in (0, 1)}


def test_line_recall(spark):
    """Of lines just over the threshold, by edited letters, replaced words or added commas, 0.98 share a key."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = ["".join(r.choice(letters) for _ in range(r.randint(2, 10))) for _ in range(5000)]
    shingles = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}

    def edited(parts, make, join):
        for at in r.sample(range(len(parts)), len(parts)):
            parts[at] = make(parts[at])
            yield join.join(parts)

    kinds = {
        "letters": lambda s: edited(list(s), lambda x: r.choice(letters), ""),
        "words": lambda s: edited(s.split(" "), lambda x: r.choice(known), " "),
        "commas": lambda s: edited(s.split(" "), lambda x: x + ",", " "),
    }
    rows = []
    for kind, edits in kinds.items():
        for n in (8, 18, 40, 150):
            want = len(rows) + 300
            while len(rows) < want:
                a = " ".join(r.choice(known) for _ in range(n))
                for b in edits(a):
                    similar = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
                    if similar <= 0.82:
                        rows += [(f"{kind} {n}", a, b)] if similar >= 0.8 else []
                        break
    found = F.arrays_overlap(line_dedup.bands(F.col("a")), line_dedup.bands(F.col("b"))).cast("int")
    got = spark.createDataFrame(rows, "kind string, a string, b string").groupBy("kind").agg(F.avg(found).alias("found"))
    recall = {x.kind: x.found for x in got.collect()}
    assert sum(recall.values()) / len(recall) >= 0.98 and min(recall.values()) >= 0.97, recall


def test_lines_of_few_shingles(spark):
    """A repeat among a line's first shingles is found by a pattern as by counting them."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(8)
    lines = ["".join(r.choice(of) for _ in range(n)) for of in ("ab", "abc\n", "你好é", "𝔘𝔫a", "abcdefgh") for n in range(1, 60)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "abcdeabcdefghijklmnop"]
    first = [x[:20] for x in lines]
    want = [len({x[i : i + 5] for i in range(max(1, len(x) - 4))}) <= 15 for x in first]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").repartition(1).orderBy("i")
    got = df.select(((F.length("line") < 20) | F.substring("line", 1, 20).rlike(line_dedup._REPEAT)).alias("few"))
    assert [x.few for x in got.collect()] == want and not all(want)


def test_plan_is_native(docs, prose):
    plan = line_dedup.deduplicate(docs([(1, prose(1, 20))]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_are_split_once(docs, prose):
    """A text that loses lines is split once, not once more for each piece between dropped lines."""
    rows = [(1, "\n".join(prose(i, 20) for i in range(9))), (2, "\n".join(prose(i if i % 2 else 50 + i, 20) for i in range(9)))]
    out = line_dedup.deduplicate(docs(rows))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "\n".join(prose(50 + i, 20) for i in range(0, 9, 2))}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and {got[i] for i in (10, 11, 12)} == {10} and {got[100 + i] for i in range(41)} == {100} and 7 not in got


def test_url_filters(spark):
    d = lambda n: dt.date(2024, 1, n)
    events = spark.createDataFrame(
        [("spam", "Example.com", "add", d(5)), ("spam", "example.com", "add", d(6)), ("spam", "example.com", "remove", d(10)), ("spam", "example.com", "add", d(10)), ("spam", "example.com", "remove", d(20)), ("adult", "b.example.com.", "add", d(8)), ("x", None, "add", d(1))],
        "list_name string, rule string, action string, at date",
    )
    rows = [(1, "http://example.com/a", d(4)), (2, "https://u@A.EXAMPLE.com:80/x?y", d(5)), (3, "http://b.example.com", d(9)), (4, "http://example.com", d(20)), (5, None, d(9)), (6, "http://badexample.com", d(9)), (7, "http://example.com", None), (3, "http://b.example.com", d(9)), (8, "http://example.com", d(10))]
    caps = spark.createDataFrame([(*r, "kept") for r in rows], "id int, url string, fetched_at date, rule string")
    got = sorted((r.id, len(r._active), r.rule) for r in url_filters.evaluate(caps, events).collect())
    assert got == [(1, 0, "kept"), (2, 1, "kept"), (3, 2, "kept"), (3, 2, "kept"), (4, 0, "kept"), (5, 0, "kept"), (6, 0, "kept"), (7, 0, "kept"), (8, 1, "kept")]
    assert url_filters.evaluate(caps, events.limit(0)).count() == len(rows) and url_filters.evaluate(caps.limit(0), events).count() == 0


def test_url_history_is_not_gathered(spark):
    """A rule that is added and removed very often: what is active is right, and no row holds the history."""
    import re

    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    events = spark.createDataFrame([("spam", "example.com", "remove" if n % 2 else "add", d(n)) for n in range(399)] + [("old", "a.example.com", "add", d(-900))], "list_name string, rule string, action string, at date")
    caps = spark.createDataFrame([(n, "http://a.example.com/x", d(n)) for n in range(-50, 450)], "id int, url string, fetched_at date")
    out = url_filters.evaluate(caps, events)
    spam = lambda n: ["spam"] if n >= 398 or (n >= 0 and n % 2 == 0) else []
    assert {r.id: [x.list_name for x in r._active] for r in out.collect()} == {n: ["old", *spam(n)] for n in range(-50, 450)}
    gathered = re.findall(r"collect_set\(struct\(([^)]*)", out._jdf.queryExecution().toString())
    assert gathered and not any("valid_from" in x for x in gathered)


@given(st.text(st.sampled_from("<|\\im_start>end\nab"), max_size=30), st.text(st.sampled_from("ab\n\\<|"), max_size=6))
def test_turns_round_trip(text, role):
    piece, begin, end = chat_format.render(role, text)
    again, _, _ = chat_format.render("user", "next " + text)
    assert list(chat_format.parse(piece + again)) == [(role, text), ("user", "next " + text)]
    assert chat_format.unescape(piece[begin:end]) == text


def test_event_log(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", None), (1, 3, 2, "delta", None, "Hel"), (1, 4, 2, "delta", None, "lo"),
        (1, 5, 3, "message", "user", "dropped"), (1, 6, 2, "regenerate", None, None), (1, 7, 2, "message", "assistant", "Good"), (1, 8, 2, "delta", None, " day"), (1, 9, 1, "edit", None, "hi!"),
        (2, None, 1, "delta", "user", "a"), (2, 1, 1, "delta", None, "b"), (2, 2, 9, "regenerate", None, None), (None, 1, 1, "message", None, "x"),
    ]
    df = spark.createDataFrame(log, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    got = sorted(((r.conv_id or 0), r.message_no, r.role, r.text) for r in chat_format.reconstruct(df).collect())
    assert got == [(0, 0, "", "x"), (1, 0, "user", "hi!"), (1, 1, "assistant", "Good day"), (2, 0, "user", "ab")]
    assert chat_format.reconstruct(df.limit(0)).count() == 0


def test_digests(spark):
    import hashlib

    turns = spark.createDataFrame([(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "é\n"), (1, 1, "assistant", None), (2, 5, None, "q")], "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_messages(chat_format.reconstruct(chat_format.from_turns(turns)))).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == 2 and out[1].loss_sha256 == hashlib.sha256("é\n".encode()).hexdigest()
    assert out[1].turns_sha256 == hashlib.sha256("user\n<|im_end|>\nassistant\n\nassistant\né\n\n".encode()).hexdigest()


def test_registered_chats(spark):
    """The registered query against digests of the turns themselves; its log has drafts, edits and regenerations."""
    import hashlib
    from collections import defaultdict

    from panelforge.llm import queries

    data, extra = "/root/testdata/sf0.001", "<|im_end|><|im_start|>assistant ok"
    chats = defaultdict(list)
    turns = queries.table(spark, data, "conversations")
    for r in turns.collect():
        chats[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    chats[-1] = [(0, "user", extra), (1, "assistant", extra)]
    kinds = {r.kind for r in chat_format.from_turns(turns.select("conv_id", "turn", "role", "text")).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for cid, rows in chats.items():
        rows.sort()
        learnt = "".join(t for _, role, t in rows if role == "assistant")
        want.add((cid, len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(learnt), sha(learnt)))
    got = {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat_format(spark, data).collect()}
    assert got == want


def test_url_columns_may_clash(spark):
    caps = spark.createDataFrame([(1, "http://[2001:DB8::1]:80/x", dt.date(2024, 1, 2), "a", "h", 5), (2, "http://a.b", None, "b", "h", 6)], "id int, url string, fetched_at date, _active string, _HOST string, active int")
    events = spark.createDataFrame([("v6", "[2001:db8::1]", "add", dt.date(2024, 1, 1))], "list_name string, rule string, action string, at date")
    out = url_filters.evaluate(caps, events)
    assert out.columns == ["__host", *caps.columns, "__active"]
    assert sorted((r.id, r._active, r._HOST, r.active, r["__host"], len(r["__active"])) for r in out.collect()) == [(1, "a", "h", 5, "[2001:db8::1]", 1), (2, "b", "h", 6, "a.b", 0)]


def test_ids_removed_beside_own_column_names(spark):
    from panelforge.llm.common import without_ids

    rows = [(i, i, f"s{i}", i, True, "r") for i in range(20)] + [(None, 1, "n", 1, False, "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, _pf_slot bigint, _pf_bucket string, _pf_bits bigint, _pf_maybe boolean, row string")
    out = without_ids(df, "doc_id", spark.createDataFrame([(3,), (5,), (99,)], "doc_id bigint"))
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(str(r) for r in df.collect() if r.doc_id not in (3, 5))


def brute_components(lines):
    """Components of distinct lines by the exact similarity of their character shingles."""
    sets = [{s[i : i + 5] for i in range(len(s) - 4)} or {s} for s in lines]
    names = list(range(len(lines)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 100 * small >= 80 * large:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (small + large - common):
                    a, b = root(i), root(j)
                    names[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(lines))]


def test_short_lines_beside_others_of_their_beginning(docs):
    """Pairs of 14 and 15 characters, each among other lines with the same first 12: every link is kept."""
    import random

    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(150):
        head = word(14)
        lines += [head, head + word(1)] + [head[:12] + word(r.randrange(4, 9)) for _ in range(19)]
    lines = list(dict.fromkeys(lines))
    r.shuffle(lines)
    out = {x.doc_id: x.text for x in line_dedup.deduplicate(docs(list(enumerate(lines)))).collect()}
    assert [bool(out[i]) for i in range(len(lines))] == [c == i for i, c in enumerate(brute_components(lines))]


def test_lines_against_brute_force(docs):
    """Random lines of many lengths and alphabets with edited copies: the lines that stay are those of brute force."""
    import random

    r = random.Random(9)
    lines = []
    for alphabet in ("abcdefghijklmnopqrstuvwxyz ", "0123456789", "".join(map(chr, range(0x4E00, 0x4F00))), "".join(map(chr, range(0x430, 0x450)))):
        for n in (3, 5, 8, 12, 15, 16, 20, 40, 200):
            for _ in range(9):
                base = "x" + "".join(r.choice(alphabet) for _ in range(n - 1))
                lines.append(base)
                for _ in range(4):
                    copy = list(base)
                    for _ in range(max(1, n // 60)):
                        copy[r.randrange(len(copy))] = r.choice(alphabet.strip())
                    lines.append("".join(copy) + r.choice(["", "", "z"]))
    lines = list(dict.fromkeys(lines))
    r.shuffle(lines)
    out = {x.doc_id: x.text for x in line_dedup.deduplicate(docs(list(enumerate(lines)))).collect()}
    want = [c == i for i, c in enumerate(brute_components(lines))]
    got = [bool(out[i]) for i in range(len(lines))]
    assert all(w <= g for w, g in zip(want, got))  # none is dropped wrongly
    assert sum(g != w for w, g in zip(want, got)) <= 0.01 * want.count(False)  # recall


def test_no_folder_is_configured():
    """A local session without spark.checkpoint.dir gets a folder of its own, and remembers it."""
    import os
    import subprocess
    import sys

    code = (
        "import tempfile\nfrom pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from panelforge.llm.common import materialize, shared_dir\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "assert materialize(s.range(5), 't').count() == 5 and shared_dir(s) == shared_dir(s)\nprint('fine')"
    )
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import tempfile

    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(), "PYTHONPATH": top}
    assert "fine" in subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout
