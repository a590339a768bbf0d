"""An optional text model, called on the driver for single finished reports; templates serve where there is none."""

from __future__ import annotations

import json
import urllib.request
from typing import Protocol

from ..operators.decision import DISCLAIMER


class Provider(Protocol):
    def generate(self, prompt: str, system: str = "") -> str | None: ...


class HttpProvider:
    """A local generate endpoint; None on any failure, so that the template is used instead."""

    def __init__(self, url: str, model: str, probe_seconds: float = 5, seconds: float = 60):
        self.url, self.model, self.probe_seconds, self.seconds = url.rstrip("/"), model, probe_seconds, seconds

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(self.url, timeout=self.probe_seconds) as r:
                return r.status == 200
        except (OSError, ValueError):
            return False

    def generate(self, prompt: str, system: str = "") -> str | None:
        body = json.dumps({"model": self.model, "prompt": prompt, "system": system, "stream": False}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"}), timeout=self.seconds) as r:
                return json.load(r).get("response") or None
        except (OSError, ValueError):
            return None


def assisted(symptoms: str, candidates: list[dict], template: str, provider: Provider | None = None) -> str:
    """A model's guidance from the first three candidates with the disclaimer, or the template's text."""
    if provider is None:
        return template
    listed = "".join(f"- {c['label']} (score: {c['score']:.3f}, source: {c['source']})\n" for c in candidates[:3]) or "No relevant candidates were found.\n"
    answer = provider.generate(f'User symptoms: "{symptoms}"\nCandidates (not sure enough for a diagnosis):\n{listed}')
    return f"{answer}\n\n{DISCLAIMER}" if answer else template
