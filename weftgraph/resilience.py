"""Retries, a circuit breaker and a health check for actions on outside systems.

Spark retries lost tasks by itself; these guard what the driver does around it.
"""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable
from enum import Enum
from typing import Any

log = logging.getLogger(__name__)


class TransientError(Exception):
    """An error worth another attempt."""


class MaxRetriesExceeded(Exception):
    def __init__(self, attempts: int, last_error: Exception | None) -> None:
        super().__init__(f"Failed after {attempts} attempts: {last_error}")
        self.attempts, self.last_error = attempts, last_error


RETRYABLE = (TransientError, OSError)


def retry(fn: Callable, *args: Any, max_attempts: int = 3, base_delay: float = 1.0, max_delay: float = 30.0, backoff_factor: float = 2.0, retryable_exceptions: tuple = (Exception,), **kwargs: Any) -> Any:
    """The result of `fn`, tried up to `max_attempts` times with growing, jittered pauses."""
    error: Exception | None = None
    for nth in range(max_attempts):
        if nth:
            pause = min(base_delay * backoff_factor ** (nth - 1), max_delay)
            time.sleep(pause + random.uniform(0, 0.1 * pause))
        try:
            return fn(*args, **kwargs)
        except retryable_exceptions as e:
            error = e
            log.warning("attempt %d of %d failed: %s", nth + 1, max_attempts, e)
    raise MaxRetriesExceeded(max_attempts, error)


class CircuitState(Enum):
    CLOSED = "closed"
    OPEN = "open"
    HALF_OPEN = "half_open"


class CircuitBreakerOpen(Exception):
    """A call was turned away."""


class CircuitBreaker:
    """Turns calls away for `recovery_timeout` seconds after `failure_threshold` failures in a row."""

    def __init__(self, failure_threshold: int = 5, recovery_timeout: float = 30.0) -> None:
        self.failure_threshold, self.recovery_timeout = failure_threshold, recovery_timeout
        self.state, self._failures, self._failed_at = CircuitState.CLOSED, 0, 0.0

    def call(self, fn: Callable, *args: Any, **kwargs: Any) -> Any:
        if self.state is CircuitState.OPEN:
            if time.time() - self._failed_at < self.recovery_timeout:
                raise CircuitBreakerOpen(f"open for {self.recovery_timeout} s after {self._failures} failures")
            self.state = CircuitState.HALF_OPEN
        try:
            out = fn(*args, **kwargs)
        except Exception:
            self._failures, self._failed_at = self._failures + 1, time.time()
            if self._failures >= self.failure_threshold:
                self.state = CircuitState.OPEN
            raise
        self._failures, self.state = 0, CircuitState.CLOSED
        return out


def healthy(check: Callable[[], Any]) -> bool:
    """Whether a check runs without error."""
    try:
        check()
    except Exception as e:  # any failure means unhealthy
        log.error("health check failed: %s", e)
        return False
    return True
