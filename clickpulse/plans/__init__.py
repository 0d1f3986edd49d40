"""Stages wired into whole plans, the registered queries and their SQL."""
