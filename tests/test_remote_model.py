"""The HTTP client against a server in this process: all modes, one retry, errors as a column."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from granary.agents import client, discussion
from granary.agents.remote import remote
from pyspark.sql import functions as F


class Server(BaseHTTPRequestHandler):
    seen: list = []
    busy: set = set()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = body["messages"][-1]["content"] if "messages" in body else body["prompt"]
        self.seen.append((self.path, body, self.headers["Authorization"]))
        if "broken" in said or ("once" in said and said not in self.busy):
            self.busy.add(said)
            self.send_error(500)
            return
        if self.path.endswith("chat/completions"):
            out = [{"message": {"content": None if "mute" in said else said.upper()}}]
        else:
            out = [{"text": f"<{body.get('suffix', '')}|{k}>", "logprobs": {"tokens": ["a", "b"], "token_logprobs": [None, -0.5 * k]}} for k in range(body.get("n", 1))]
        data = json.dumps({"choices": out}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def model():
    Server.seen, Server.busy = [], set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield remote(url=f"http://127.0.0.1:{server.server_port}/v1/", model="m", key="k", temperature=0.2, stop=("<end>",), timeout=20)
    server.shutdown()


def test_chat_retries_once_and_keeps_errors(spark, model):
    rows = spark.createDataFrame([(1, "hi"), (2, "once"), (3, "broken"), (4, "mute")], "id long, text string").select("id", F.lit("m").alias("member"), F.array(client.user(F.col("text"))).alias("history"))
    got = {r.id: r for r in client.speak(rows, model).collect()}
    assert [got[i].history[-1].content for i in (1, 2, 3, 4)] == ["HI", "ONCE", "", ""]
    assert got[3].err_msg and not got[1].err_msg and not got[2].err_msg and got[2].seconds > 0
    assert len(Server.seen) == 1 + 2 + 2 + 1
    path, body, key = Server.seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and (body["model"], body["temperature"], body["stop"]) == ("m", 0.2, ["<end>"])


def test_continued_and_filled_answers(spark, model):
    rows = spark.createDataFrame([(1, "q", "assert("), (2, "once", None), (3, "broken", "x")], "id long, text string, prefix string").select("id", F.array(client.user(F.col("text"))).alias("history"), "prefix")
    got = {r.id: r for r in client.continue_answers(rows, model).collect()}
    assert got[1].response == "assert(<|0>" and got[2].response == "<|0>" and got[3].response == "" and got[3].err_msg
    assert any(b["prompt"].endswith("user: q\nassistant: assert(") for _, b, _ in Server.seen)
    holes = spark.createDataFrame([(1, "int f() {", "}"), (2, None, None)], "id long, before string, after string")
    assert {r.id: r.middle for r in client.fill(holes, model).collect()} == {1: "<}|0>", 2: "<|0>"}


def test_samples_have_their_confidence(spark, model):
    rows = spark.createDataFrame([(1, "q", "p(")], "id long, text string, prefix string").select("id", F.array(client.user(F.col("text"))).alias("history"), "prefix")
    got = sorted((r.response, r.prob) for r in discussion.sampled(rows, model, 3).collect())
    assert got == [("p(<|0>", 100.0), ("p(<|1>", 60.65), ("p(<|2>", 36.79)]
