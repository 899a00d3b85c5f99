"""Dataflow operators over panels, scenarios, forecasts and decisions."""
