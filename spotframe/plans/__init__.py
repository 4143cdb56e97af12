"""Registered queries: operators applied to tables, each with the SQL that gives the same rows."""

from spotframe.plans import q_calib, q_embed, q_frames, q_more, q_spots, q_traces, q_voxels
from spotframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_calib", "q_embed", "q_frames", "q_more", "q_spots", "q_traces", "q_voxels"]
