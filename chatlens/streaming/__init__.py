"""Structured Streaming jobs."""

from chatlens.streaming.incremental import (dedupe_stream, event_time_counts, stream_first_wins,
                                            stream_window_counts, window_counts)

__all__ = ["dedupe_stream", "event_time_counts", "stream_first_wins", "stream_window_counts", "window_counts"]
