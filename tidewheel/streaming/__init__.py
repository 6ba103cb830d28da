from tidewheel.streaming.live import live, live_asof, live_cycles, live_intervals, live_rolling, live_running

__all__ = ["live", "live_asof", "live_cycles", "live_intervals", "live_rolling", "live_running"]
