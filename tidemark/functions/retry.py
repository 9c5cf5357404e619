"""Trying an action again."""

from __future__ import annotations

import time
from collections.abc import Callable


def until_success[T](action: Callable[[], T], timeout: float = 600.0, first_wait: float = 15.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> T:
    """The result of `action`, tried again after 15, 30, 60, ... seconds; TimeoutError, from its error, past `timeout`.

    A timeout of 0 allows one attempt.
    """
    began, wait = clock(), first_wait
    while True:
        try:
            return action()
        except Exception as e:
            if clock() - began + wait > timeout:
                raise TimeoutError(f"no success within {timeout} seconds") from e
        sleep(wait)
        wait *= 2
