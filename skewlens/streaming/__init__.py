from skewlens.streaming.incremental import (compact_stream, read_stream_partials, read_stream_stats,
                                            read_stream_tasks, start_stage_stats_stream)

__all__ = ["compact_stream", "read_stream_partials", "read_stream_stats", "read_stream_tasks", "start_stage_stats_stream"]
