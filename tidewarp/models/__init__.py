"""Forecasters. Each trains per series inside grouped functions; see registry for the names."""
