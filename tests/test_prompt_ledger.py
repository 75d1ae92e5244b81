"""Batches of prompts against an endpoint of our own."""

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docspark.operators import generation, prompt_ledger
from docspark.plans.workers import with_workers

LATENCY = 0.05


@pytest.fixture
def server():
    seen, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):  # noqa: N802
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            with lock:
                seen[prompt] += 1
                times = seen[prompt]
            time.sleep(LATENCY)
            status = 429 if "busy" in prompt and times == 1 else 503 if "broken" in prompt else 400 if "refused" in prompt else 200
            said = json.dumps({"choices": [{"message": {"content": f"said to {prompt[-12:]}"}}], "usage": {"total_tokens": 3}}).encode()
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "1")
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    class Server(ThreadingHTTPServer):
        request_queue_size = 128

    made = Server(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/chat", seen
    made.shutdown()


def prompts(spark, n):
    return with_workers(spark).range(n).select("id", F.format_string("prompt %06d", "id").alias("__prompt"))


def test_a_killed_stage_sends_nothing_twice(spark, server, tmp_path):
    url, seen = server
    ledger = f"file://{tmp_path}/ledger"

    class Dying(generation.Endpoint):
        def send(self, session, before, prompt):
            if len(list(Path(ledger.removeprefix("file://")).rglob("[!_.]*.parquet"))) >= 8:  # as it begins another part
                os._exit(1)
            return super().send(session, before, prompt)

    with pytest.raises(Exception, match="(?i)crashed|worker"):
        prompt_ledger.answered(prompts(spark, 1000), Dying(url=url, key="k", concurrency=16), [], ledger, tasks=1)
    assert len(seen) == 8 * prompt_ledger.FLUSH
    told = generation.Endpoint(url=url, key="k", concurrency=16)
    start = time.time()
    rows = prompt_ledger.answered(prompts(spark, 1000), told, [], ledger, tasks=1).collect()
    took = time.time() - start
    assert len(rows) == 1000 and all(f"said to rompt {r.id:06d}" in r["__said"] for r in rows)
    assert len(seen) == 1000 and set(seen.values()) == {1}
    assert took < 488 * LATENCY / 2  # one after another it would take 24 s, in sixteens about 2
    prompt_ledger.answered(prompts(spark, 1000), told, [], ledger).count()
    assert set(seen.values()) == {1}
    other = generation.Endpoint(url=url, key="k", model="another", concurrency=16)  # another request, so it is sent
    prompt_ledger.answered(prompts(spark, 10), other, [], ledger).count()
    assert sum(seen.values()) == 1010


def test_tries_again_where_that_helps(spark, server):
    url, seen = server
    told = generation.Endpoint(url=url, key="k", retries=2, backoff=0.01)
    start = time.time()
    assert [x is not None for x in told.send_all([], ["fine", "busy", "broken", "refused", None])] == [True, True, False, False, False]
    assert seen == {"fine": 1, "busy": 2, "broken": 3, "refused": 1} and time.time() - start >= 1


@pytest.mark.parametrize("kept", [False, True])
def test_answers_by_the_endpoint(spark, server, tmp_path, kept):
    url, seen = server
    told = generation.Endpoint(url=url, key="k", retries=0)
    rows = [(1, "why?", "c"), (2, "why?", "c"), (3, "broken", "c"), (4, None, "c")]
    asked = with_workers(spark).createDataFrame(rows, "query_id int, question string, context string").withColumn("said", F.array(F.lit(1)))
    ledger = f"file://{tmp_path}/ledger" if kept else None
    got = {r.query_id: r for r in generation.answers(asked, told, ledger).collect()}
    assert got[1].answer == got[2].answer and got[1].answer.startswith("said to ") and got[1].usage.total_tokens == 3 and got[1].model == told.model and got[1].said == [1]
    assert got[3].model == "stub" and got[4].model == "stub" and got[3].usage.total_tokens == 0
    assert sum(seen.values()) == (2 if kept else 3)
    assert generation.answers(asked.filter("false"), told, ledger).count() == 0
