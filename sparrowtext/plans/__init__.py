"""Query trees and how they compile to DataFrames."""
