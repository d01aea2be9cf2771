"""Redaction against a plain version of its steps, and the time of a text with very many values."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from heapstone.functions import redact


def sensitive(key):
    return re.search("|".join(redact.SENSITIVE), key.upper()) or re.match("|".join(redact.SENSITIVE_STARTS), key.upper())


def host(name):
    if not re.search("[A-Za-z]", name) or name.lower().startswith("redacted-") or re.search("|".join(redact.MODELS), name.lower()):
        return False
    if any(re.search(p, name) for p in (r"^\d+(?:\.\d+)+[a-zA-Z%]*$", r"^(?:[a-z_][a-z0-9_]*\.)+[A-Z][A-Za-z0-9_$-]*$", r"^[A-Za-z][A-Za-z0-9-]*\.[0-9]+$", r"^[A-Z][A-Za-z0-9_$-]*\.[a-z][A-Za-z0-9_$-]*$")):
        return False
    return not (name.count(".") < 3 and name.lower().rsplit(".", 1)[-1] in redact.FILE_ENDINGS)


def plain(texts):
    """Texts of one report in order, redacted step by step; values numbered by kind from where they first stand."""
    marked = []
    for text in texts:
        values = []

        def put(kind, value, values=values):
            values.append((kind, value))
            return f")\ue000{len(values) - 1}\ue001)"

        for step in redact.STEPS:
            def found(m, step=step, put=put):
                if step.kept:
                    a, b, c = m[1], m[2], m[3]
                    new = put(step.kind, f"{a}={c}" if step.name == "env" else c)
                    return a + b + new if step.name != "env" or sensitive(a) else m[0]
                new = put(step.kind, m[0])
                return new if step.name != "host" or host(m[0]) else m[0]

            text = re.sub(step.pattern, found, text)
        marked.append((text, values))
    numbers, out = {}, []
    for text, values in marked:
        for n in sorted(int(x) for x in re.findall("\ue000(\\d+)\ue001", text)):
            numbers.setdefault(values[n], 1 + sum(k[0] == values[n][0] for k in numbers))
    for text, values in marked:
        out.append(re.sub("\\)\ue000(\\d+)\ue001\\)", lambda m, values=values: f"[redacted-{values[int(m[1])][0]}-{numbers[values[int(m[1])]]}]", text))
    return out


PIECES = ["java command: run /opt/app --x", "command line = /bin/java -jar a.jar", "AWS_REGION=eu-1", "DB_PASSWORD=p,q", "LANG=C", "/var/log/app/a.log", "C:\\Users\\me\\x.txt", "10.0.0.7", "db1.corp.example.com", "a.txt", "com.shop.Order", "2.5ms", "gpt.example.com", "node7.local", "x=y", "", "plain words", "host.name.io:8080", "(see /tmp/x)"]


def test_reports_as_a_plain_version_of_the_steps_redacts_them(spark):
    rng = random.Random(4)
    rows = [(f"r{k % 4}", k, "\n".join(" ".join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 4)))) for k in range(80)]
    frame = spark.createDataFrame([*rows, ("r9", 1, None)], "report string, k int, text string")
    found = {(r["report"], r["k"]): r["text"] for r in redact.redact_report(frame, ["report"], "k", "text").collect()}
    for report in ("r0", "r1", "r2", "r3"):
        mine = [r for r in rows if r[0] == report]
        assert [found[report, r[1]] for r in mine] == plain([r[2] for r in mine])
    assert found["r9", 1] is None
    single = {r["k"]: r["text"] for r in frame.withColumn("text", redact.redact(F.col("text"))).collect() if r["report"] != "r9"}
    assert single == {k: plain([text])[0] for _, k, text in rows}
    assert {r["k"]: r["text"] for r in redact.redact_texts(frame.where("report <> 'r9'"), ["report", "k"], "text").collect()} == single


def test_a_text_of_very_many_values_takes_time_in_proportion(spark):
    def took(n):
        text = " ".join(f"host{k}.corp{k % 97}.example.com said hello to the other machine" for k in range(n))
        frame = spark.createDataFrame([(1, 0, text)], "k long, o long, text string")
        began = time.perf_counter()
        end = redact.redact_report(frame, ["k"], "o", "text").select(F.substring("text", -60, 60).alias("t")).first()["t"]
        assert f"[redacted-host-{n}]" in end
        return time.perf_counter() - began

    took(100)
    assert took(50_000) < 60


def test_a_text_that_already_holds_a_placeholder_keeps_it(spark):
    frame = spark.createDataFrame([(1, 0, "odd )\ue0007\ue001) and 10.0.0.1")], "k long, o long, text string")
    assert redact.redact_report(frame, ["k"], "o", "text").first()["text"] == frame.withColumn("text", redact.redact(F.col("text"))).first()["text"] == "odd )\ue0007\ue001) and [redacted-host-1]"
