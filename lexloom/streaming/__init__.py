"""lexloom.streaming"""
