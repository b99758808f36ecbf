"""JSON over HTTP with waits between tries."""

from __future__ import annotations

import json
import random
import threading
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

# Answers of a service that is busy or failing, after which another try makes sense.
AGAIN = [429, 500, 502, 503, 520, 529]


class HttpError(RuntimeError):
    """status: the answer's, or 0 where there was none; the text is its beginning."""

    def __init__(self, status: int, text: str):
        super().__init__(f"HTTP {status}: {text}" if status else text)
        self.status = status

    @property
    def elsewhere(self) -> bool:
        """Whether another service may do better: the request itself was not refused."""
        return not 400 <= self.status < 500


@dataclass(frozen=True)
class Patience:
    tries: int = 4
    timeout: float = 60
    first_wait: float = 0.5

    def wait(self, failed: int, asked_for: float) -> float:
        """Seconds before the next try: what the service asks for, and at least a doubling time with some chance in it."""
        return max(asked_for, self.first_wait * 2 ** (failed - 1) * random.uniform(1, 1.5))


def post_json(url: str, body: dict, token: str = "", patience: Patience = Patience()) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    data, failed = json.dumps(body).encode(), 0
    while True:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=patience.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            error, asked = HttpError(e.code, e.read(300).decode("utf-8", "replace")), e.headers.get("retry-after") or ""
        except (OSError, ValueError) as e:
            error, asked = HttpError(0, f"{type(e).__name__}: {e}"), ""
        failed += 1
        if failed >= patience.tries or error.status not in (0, *AGAIN):
            raise error
        time.sleep(patience.wait(failed, float(asked) if asked.replace(".", "", 1).isdigit() else 0.0))


@dataclass(frozen=True)
class Endpoint:
    """A service: where it is, its model and price, and how patiently it is asked."""

    url: str
    model: str = ""
    usd_per_token: float = 0.0
    workers: int = 32
    patience: Patience = Patience()


class Chain:
    """Services that can stand for each other, in the order of preference. One that fails for good is passed over from then on,
    by all that share the chain."""

    def __init__(self, endpoints: list[Endpoint], token: str = ""):
        self.endpoints, self.token, self.failures = endpoints, token, []
        self.lock = threading.Lock()

    @property
    def current(self) -> Endpoint:
        return self.endpoints[len(self.failures)]

    def ask(self, path: str, body: dict) -> dict:
        for place in range(len(self.failures), len(self.endpoints)):
            own = self.endpoints[place]
            try:
                return post_json(own.url.rstrip("/") + path, {"model": own.model} | body, self.token, own.patience)
            except HttpError as e:
                if not e.elsewhere or place + 1 == len(self.endpoints):
                    raise
                with self.lock:
                    if len(self.failures) == place:
                        self.failures.append(str(e)[:120])
        raise AssertionError
