"""The pipeline's stages, for a driver that looks for them at the top of the repository; the code is lodestar.llm.pipeline."""

from lodestar.llm.pipeline import ORACLE_SQL, STAGES, cut_repeats, drop_toxic, keep_one_of_near_copies, mix_sources, pack_sequences, run

__all__ = ["ORACLE_SQL", "STAGES", "cut_repeats", "drop_toxic", "keep_one_of_near_copies", "mix_sources", "pack_sequences", "run"]
