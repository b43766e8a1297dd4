"""Incremental note state with Structured Streaming."""

from notewise.streaming.payments import latest_notes, note_state_stream, start_note_stream

__all__ = ["note_state_stream", "start_note_stream", "latest_notes"]
