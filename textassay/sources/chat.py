"""A model behind an HTTP endpoint for chat completions, as a transport for harvests."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from textassay.operators.harvest import Config, Model

MOST_TOKENS = 1024


def chat_transport(config: Config, open_url: Callable = urllib.request.urlopen) -> Callable[[Model, str], tuple[str, str]]:
    """Asks one prompt of one model, not streamed; answers with the text and the model that the endpoint names.

    An ``error`` in the answer, and a status that is none of success, raise; a
    missing content is an empty text.
    """
    url = config.base_url.rstrip("/") + "/chat/completions"
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {config.api_key}"} if config.api_key else {})

    def ask(model: Model, prompt: str) -> tuple[str, str]:
        wanted = {"model": model.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": MOST_TOKENS, "stream": False}
        request = urllib.request.Request(url, json.dumps(wanted).encode(), headers)
        try:
            with open_url(request, timeout=config.timeout_secs) as response:
                said = json.load(response)
        except urllib.error.HTTPError as error:
            raise RuntimeError(f"HTTP {error.code}: {error.reason}") from error
        if said.get("error"):
            raise RuntimeError(json.dumps(said["error"]))
        choice = (said.get("choices") or [{}])[0]
        return (choice.get("message") or {}).get("content") or "", said.get("model") or model.model

    return ask
