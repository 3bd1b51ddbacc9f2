"""Structured Streaming forms of three read/write paths.

Each builder works on a streaming DataFrame *and* on a static one (watermarks
are no-ops in batch), so the registered batch queries and the streaming jobs
share one definition.
"""

from tillpoint.streaming.jobs import (audit_log_stream, code_match, revenue_hourly, start_audit_sink,
                                      start_memory_sink)

__all__ = ["revenue_hourly", "code_match", "audit_log_stream", "start_memory_sink", "start_audit_sink"]
