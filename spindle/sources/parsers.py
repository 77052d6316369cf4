"""Parsers of documents for `files.read_files`: over HTTP, local, and one after another. They are pickled to the tasks that read files."""

from __future__ import annotations

import urllib.request
import uuid
from dataclasses import dataclass

from spindle.sources.files import office_text


@dataclass(frozen=True)
class HttpParser:
    """Posts a file as the form field `field` and takes the answer's body as its text. A request that takes longer than timeout seconds, or any status but 2xx, is an error."""

    endpoint: str
    api_key: str = ""
    timeout: float = 120.0
    field: str = "file"

    def __call__(self, name: str, content: bytes) -> str:
        edge = uuid.uuid4().hex
        quoted = name.replace("\\", "\\\\").replace('"', '\\"').replace("\r", " ").replace("\n", " ")
        head = f'--{edge}\r\nContent-Disposition: form-data; name="{self.field}"; filename="{quoted}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        headers = {"Content-Type": f"multipart/form-data; boundary={edge}"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.endpoint, head.encode() + content + f"\r\n--{edge}--\r\n".encode(), headers, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout if self.timeout > 0 else 120.0) as answer:
            return answer.read().decode("utf-8")


def local(name: str, content: bytes) -> str:
    """Text of zipped office formats, and of files that are text."""
    ext = name.rpartition(".")[2].lower()
    if ext in ("docx", "odt", "pptx", "epub", "xlsx"):
        return office_text(ext, content)
    if ext in ("md", "txt"):
        return content.decode("utf-8")
    raise ValueError(f"no local parser for {ext}")


class Chain:
    """The first parser's text; where it fails or finds none, the next one's. If all fail, one error names each."""

    def __init__(self, *parsers):
        self.parsers = parsers

    def __call__(self, name: str, content: bytes) -> str:
        errors = []
        for parser in self.parsers:
            try:
                if (text := parser(name, content)).strip():
                    return text
                errors.append("no text")
            except Exception as e:  # whatever one parser can't read the next may
                errors.append(str(e) or type(e).__name__)
        raise ValueError("; ".join(errors))
