"""Operators for preparing training text at corpus scale; each module is one operator."""
