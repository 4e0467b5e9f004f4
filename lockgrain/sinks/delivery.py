"""Where reports go: a sticky comment that is updated in place, and uploads, through adapters that the caller passes in."""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from lockgrain.sinks.report import MARK, OLD_MARKS

PAGE = 100


class DeliveryError(RuntimeError):
    """A delivery that is not described fully, or that the service refused."""


class Comments(Protocol):
    """Comments of one request: pages of (id, author, body), creation and update."""

    def page(self, number: int, size: int) -> list[tuple[int, str | None, str | None]]: ...

    def create(self, body: str) -> int: ...

    def update(self, id_: int, body: str) -> None: ...


@dataclass(frozen=True)
class Published:
    """created, updated or summary-only, with the comment's id or the reason."""

    status: str
    comment: int | None = None
    reason: str | None = None


def _tried(doing: str, call: Callable, *arguments: object) -> object:
    try:
        return call(*arguments)
    except Exception as e:
        raise DeliveryError(f"failed to {doing}") from e


def publish(body: str, comments: Comments, author: str, read_only: str | None = None, add_summary: Callable[[str], None] | None = None, warn: Callable[[str], None] = lambda _: None) -> Published:
    """Update the newest comment of ``author`` that bears the mark, or create one.

    Where comments cannot be written (``read_only`` says why), the body becomes the job's summary.
    """
    if MARK not in body or not author:
        raise DeliveryError("a delivery needs an author and a body that bears the mark")
    if read_only:
        _tried("write the job summary", add_summary, body)
        return Published("summary-only", reason=read_only)
    own, number, found = [], 1, None
    while found is None or len(found) == PAGE:
        found = _tried("list comments", comments.page, number, PAGE)
        own += [i for i, who, text in found if who == author and any(m in (text or "") for m in (MARK, *OLD_MARKS))]
        number += 1
    if not own:
        return Published("created", _tried("create the comment", comments.create, body))
    if len(own) > 1:
        warn(f"found {len(own)} comments of our own; updating the newest, {max(own)}")
    _tried("update the comment", comments.update, max(own), body)
    return Published("updated", max(own))


def packed_sarif(text: str) -> str:
    """SARIF as code-scanning services take it: gzip in base64, the same bytes for the same text."""
    return base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()


class Uploads(Protocol):
    """An artifact store and a code-scanning service."""

    def artifact(self, name: str, content: str) -> int: ...

    def sarif(self, packed: str, commit: str, ref: str) -> None: ...


def upload_json(store: Uploads, name: str, text: str) -> int:
    return _tried("upload the JSON report", store.artifact, name, text)


def upload_sarif(store: Uploads, text: str, commit: str, request: int) -> None:
    if not re.fullmatch(r"[0-9a-fA-F]{40,64}", commit) or request <= 0:
        raise DeliveryError("a SARIF upload needs a full commit id and a request number")
    _tried("upload the SARIF report", store.sarif, packed_sarif(text), commit, f"refs/pull/{request}/head")
