"""Assembly, audit, modelling and evaluation of labelled screening datasets on Spark."""

from gradewell.session import build_session, materialize, settle

__all__ = ["build_session", "materialize", "settle"]
