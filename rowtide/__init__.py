"""Row-change replay on Spark: decode change envelopes, infer schemas, replay
changes into tables, and measure the flow, all as DataFrame queries."""
