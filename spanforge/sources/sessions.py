"""Sessions that a worker process loads once, and models in a child process.

A Python worker runs many tasks, one after another.  ``shared`` hands out one session
for each name in the process and counts who holds it; a task gives it back when it is
done.  A session that nobody holds stays for ``linger`` seconds, so that the next task
need not load it again, and is closed then or when the process ends.

``LineServer`` keeps a model in a child process of its own: a prompt is a line in, the
reply stands between two marks.  Its start is bounded in time, its error stream is read
all along so that it can never block, and a child that has died is started again for
the next prompt.
"""

from __future__ import annotations

import atexit
import json
import subprocess
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from queue import Empty, Queue
from typing import Any

# The marks of the line protocol.
READY, BEGIN, END, FAILED = "###READY###", "###CAPTION_START###", "###CAPTION_END###", "__ERROR__:"


@dataclass
class _Held:
    session: Any = None
    holders: int = 0
    loading: threading.Lock = field(default_factory=threading.Lock)
    timer: threading.Timer | None = None


_sessions: dict[str, _Held] = {}
_guard = threading.RLock()


def _close(session: Any) -> None:
    close = getattr(session, "close", None)
    if close:
        close()


class Lease:
    """A share in a session; ``close`` gives it back. Calls go to the session."""

    def __init__(self, name: str, session: Any, linger: float):
        self._name, self._session, self._linger = name, session, linger

    def __getattr__(self, attribute: str) -> Any:
        if attribute.startswith("_"):
            raise AttributeError(attribute)
        session = self._session
        if session is None:
            raise RuntimeError("this share was given back")
        return getattr(session, attribute)

    def close(self) -> None:
        with _guard:
            if self._session is None:
                return
            self._session = None
            held = _sessions[self._name]
            held.holders -= 1
            if held.holders:
                return
            if self._linger <= 0:
                _drop(self._name, held)
            else:
                held.timer = threading.Timer(self._linger, _expire, [self._name, held])
                held.timer.daemon = True
                held.timer.start()

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _expire(name: str, held: _Held) -> None:
    with _guard:
        if not held.holders and _sessions.get(name) is held:
            _drop(name, held)


def _drop(name: str, held: _Held) -> None:
    del _sessions[name]
    _close(held.session)


def shared(name: str, build: Callable[[], Any], linger: float = 60.0) -> Lease:
    """A share in the process's session ``name``, which ``build`` makes if there is none.
    Others that ask meanwhile wait for it; a build that fails leaves nothing behind."""
    while True:
        with _guard:
            held = _sessions.setdefault(name, _Held())
        with held.loading:
            with _guard:
                if _sessions.get(name) is not held:
                    continue  # it went while we waited
                if held.session is not None:
                    held.holders += 1
                    if held.timer:
                        held.timer.cancel()
                        held.timer = None
                    return Lease(name, held.session, linger)
            try:
                session = build()
            except BaseException:
                with _guard:
                    if _sessions.get(name) is held:
                        del _sessions[name]
                raise
            with _guard:
                held.session, held.holders = session, 1
                return Lease(name, session, linger)


@atexit.register
def _close_all() -> None:
    with _guard:
        for name, held in list(_sessions.items()):
            del _sessions[name]
            _close(held.session)


def session_client(name: str, build: Callable[[], Any], linger: float = 60.0) -> Callable[[], Lease]:
    """A client factory for ``model_stage`` and ``batched_stage``: tasks of one process
    share one session."""
    return lambda: shared(name, build, linger)


class LineServer:
    """A client whose model runs in a child process (see the module). A prompt goes out as
    one line: the media path if there is one medium and no prompt, else JSON."""

    def __init__(self, command: list[str], start_timeout: float = 1200.0, reply_timeout: float = 600.0, cwd: str | None = None):
        self.command, self.cwd = command, cwd
        self.start_timeout, self.reply_timeout = start_timeout, reply_timeout
        self.starts = 0
        self._asking = threading.Lock()
        self._child: subprocess.Popen | None = None
        self._start()

    def _start(self) -> None:
        self._errors: deque[str] = deque(maxlen=500)
        self._lines: Queue[str | None] = Queue()
        self._child = subprocess.Popen(self.command, cwd=self.cwd, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, bufsize=1, encoding="utf-8")
        self.starts += 1
        for stream, take in ((self._child.stderr, self._errors.append), (self._child.stdout, self._lines.put)):
            threading.Thread(target=self._drain, args=(stream, take), daemon=True).start()
        end = time.monotonic() + self.start_timeout
        while True:
            line = self._line(end, "was not ready")
            if line.strip() == READY:
                return

    def _drain(self, stream, take) -> None:
        for line in stream:
            take(line)
        if take != self._errors.append:
            take(None)

    def _line(self, end: float, what: str) -> str:
        """The child's next line; an error, and an end of the child, if none comes in time."""
        try:
            line = self._lines.get(timeout=max(0.0, end - time.monotonic()))
        except Empty:
            self._kill()
            raise TimeoutError(f"{self.command[0]} {what} in time; {self._tail()}") from None
        if line is None:
            code = self._child.wait()
            raise RuntimeError(f"{self.command[0]} ended with code {code}; {self._tail()}")
        return line

    def _tail(self) -> str:
        time.sleep(0.05)  # what it said last
        return "its last errors: " + "".join(self._errors)[-4000:]

    def ask(self, prompt: str, media: list[str]) -> str:
        with self._asking:
            if self._child is None or self._child.poll() is not None:
                self._start()
            line = media[0] if len(media) == 1 and not prompt else json.dumps({"prompt": prompt, "media": media}, ensure_ascii=False)
            try:
                self._child.stdin.write(line.replace("\n", " ") + "\n")
                self._child.stdin.flush()
            except OSError as problem:
                raise RuntimeError(f"{self.command[0]} takes no more prompts; {self._tail()}") from problem
            end = time.monotonic() + self.reply_timeout
            said: list[str] = []
            begun = False
            while (got := self._line(end, "did not reply").rstrip("\n")).strip() != END:
                if got.strip() == BEGIN:
                    begun = True
                elif begun:
                    said.append(got)
        text = "\n".join(said).strip()
        if text.startswith(FAILED):
            raise RuntimeError(text.removeprefix(FAILED).strip())
        return text

    def _kill(self) -> None:
        self._child.kill()
        self._child.wait()

    def close(self) -> None:
        """End the child: by the end of its input, or by force."""
        if self._child is None:
            return
        try:
            self._child.stdin.close()
            self._child.wait(timeout=10)
        except (OSError, subprocess.TimeoutExpired):
            self._kill()
        self._child = None
