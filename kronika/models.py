"""What the engine asks of models and parsers, and deterministic stand-ins that need no network.

The stand-ins make every pipeline run and test offline; they are no claim about the quality of ranking or text.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from typing import Protocol

from kronika.operators.retrieval import plain_tokens


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, question: str, texts: list[str]) -> list[float]: ...


class LLMClient(Protocol):
    def generate(self, system: str, user: str, max_tokens: int = 1600) -> str: ...


class PdfParser(Protocol):
    def pages(self, content: bytes) -> list[str]: ...


class HashingEmbedder:
    """Stand-in: signed word hashes, unit length."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for t in plain_tokens(text or ""):
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class OverlapReranker:
    """Stand-in: share of the question's words that a text has, all of it."""

    def score(self, question: str, texts: list[str]) -> list[float]:
        q = set(plain_tokens(question))
        return [len(q & set(plain_tokens(t))) / len(q) if q else 0.0 for t in texts]


class ScriptedLLM:
    """Stand-in: gives the answers it was given, in order, the last one for good."""

    def __init__(self, *answers: str) -> None:
        self.answers, self.calls = list(answers), 0

    def generate(self, system: str, user: str, max_tokens: int = 1600) -> str:
        self.calls += 1
        return self.answers[min(self.calls, len(self.answers)) - 1]


class EchoLLM:
    """Stand-in: an empty, valid answer to every request for JSON."""

    def generate(self, system: str, user: str, max_tokens: int = 1600) -> str:
        return json.dumps({"movements": [], "notes": []})


class ChunkLLM:
    """Stand-in for extraction: one record for each chunk that the prompt names, with its pages."""

    def generate(self, system: str, user: str, max_tokens: int = 1600) -> str:
        found = re.findall(r"^CHUNK (-?\d+)\nPAGES: ([^\n]*)$", user, re.M)
        made = [
            {"date": "1943-01-01", "place": f"P{n}", "operation": f"Attack {n}", "source_chunk_ids": [int(n)], "source_pages": [int(p) for p in pages.split(", ") if p]}
            for n, pages in found
        ]
        return "```json\n" + json.dumps({"movements": made, "notes": [f"{len(made)} chunks"]}) + "\n```"


class PassingLLM:
    """Stand-in for verification: gives the records of the prompt back as they are."""

    def generate(self, system: str, user: str, max_tokens: int = 1600) -> str:
        records, _ = json.JSONDecoder().raw_decode(user[user.index("Records:") + len("Records:") :].lstrip())
        return json.dumps({"movements": records, "notes": []}, ensure_ascii=False)


# ---------------------------------------------------------------- what a site may have installed


class OpenAIClient:
    """Needs the package `openai` and its key in the environment."""

    def __init__(self, model: str) -> None:
        from openai import OpenAI

        self.client, self.model = OpenAI(), model

    def generate(self, system: str, user: str, max_tokens: int = 1600) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return self.client.chat.completions.create(model=self.model, messages=messages, max_completion_tokens=max_tokens).choices[0].message.content or ""


class AnthropicClient:
    """Needs the package `anthropic` and its key in the environment."""

    def __init__(self, model: str) -> None:
        import anthropic

        self.client, self.model = anthropic.Anthropic(), model

    def generate(self, system: str, user: str, max_tokens: int = 1600) -> str:
        answer = self.client.messages.create(model=self.model, max_tokens=max_tokens, system=system, messages=[{"role": "user", "content": user}])
        return "".join(getattr(part, "text", "") for part in answer.content)


#: Providers by name: a model's name to a client.
PROVIDERS = {"openai": OpenAIClient, "anthropic": AnthropicClient}


class SentenceEmbedder:
    """Unit vectors of a model of `sentence_transformers`."""

    def __init__(self, model: str) -> None:
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(model)

    def encode(self, texts: list[str]) -> list[list[float]]:
        return self.model.encode(texts, normalize_embeddings=True).tolist()


class CrossEncoderReranker:
    """Scores of a cross encoder of `sentence_transformers`, which reads as much of a text as it can hold."""

    def __init__(self, model: str, limit: int = 512) -> None:
        from sentence_transformers import CrossEncoder

        self.model = CrossEncoder(model, max_length=limit)

    def score(self, question: str, texts: list[str]) -> list[float]:
        return [float(x) for x in self.model.predict([(question, t) for t in texts])] if texts else []


class PdfPlumberParser:
    """Texts of the pages of a PDF file, by the package `pdfplumber`."""

    def pages(self, content: bytes) -> list[str]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [page.extract_text() or "" for page in pdf.pages]


class LinePdfParser:
    """Stand-in: form feeds part the pages of a text file."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")
