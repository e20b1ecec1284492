"""A PySpark engine for hybrid retrieval over source trees and document collections."""
