"""Plans put together from operators: steps, traces, presets, the query catalog."""
