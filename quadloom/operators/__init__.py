"""quadloom.operators"""
