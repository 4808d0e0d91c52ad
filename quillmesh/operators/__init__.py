"""quillmesh.operators"""
