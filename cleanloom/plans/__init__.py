"""Cleaning plans: model, compiler, planner, memory and the engine that runs them."""
