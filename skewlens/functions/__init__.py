from skewlens.functions.format import (display_ratio, metric_line, metric_text, pretty_bytes, pretty_time,
                                       stage_block)
